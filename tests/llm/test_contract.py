"""The registered queries over the whole of the smallest tables, against plain versions of their contracts."""

import base64
import hashlib
import struct
import sys
import zlib
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_decontaminate as dec_test  # noqa: E402
import test_pii as pii_test  # noqa: E402
import test_simhash as sim_test  # noqa: E402
import test_suffix_dedup as suffix_test  # noqa: E402
import test_token_counts as count_test  # noqa: E402

from palimpsest.llm import pii, registry  # noqa: E402
from palimpsest.llm.common import table  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name, *columns):
    return sorted(map(tuple, registry.queries()[name](spark, DATA).select(*columns).collect()), key=str)


def test_quality(spark, docs):
    quality = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    got = registry.queries()["op1_quality"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
    assert sum(held) >= 0.9 * len(held) > 0


def test_encoding(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(t or "")) for d, t in docs]
    assert rows(spark, "op3_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_decontamination(spark, docs):
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    want = [(d, n, hit, len(names), sha(",".join(names)), hit > 0) for d, n, hit, names in dec_test.brute(docs, items, 10)]
    got = rows(spark, "op4_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=str) and any(r[-1] for r in got)


def test_repeated_strings(spark, docs):
    got = rows(spark, "op5_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == suffix_test.brute(docs, 100) and any(r[2] for r in got)


def test_fingerprints(spark, docs):
    assert rows(spark, "op6_simhash", "doc_id", "fingerprint", "component_id") == sim_test.brute(docs)


def test_personal_data(spark, docs):
    found, flagged = pii_test.brute(docs, pii.THRESHOLD)
    want = []
    for d, spans, terms in found:
        n = [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        base = pii._joined(spans)
        want.append((d, *n, sha(base), ",".join([*([base] if base else []), *(f"term:{a}:{b}" for a, b, _ in terms)])))
    assert flagged and rows(spark, "op9_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == sorted(want, key=str)


def test_token_counts(spark, docs):
    vocabulary = {base64.b64decode(line.split()[0]) for line in open(count_test.PATH, "rb")}
    pieces = {w: count_test.greedy(w, vocabulary) for w in {w for _, t in docs for w in (t or "").encode().split()}}
    frame = registry.queries()["op10_token_counts"](spark, DATA)
    assert {r.doc_id: r.n_tokens for r in frame.collect()} == {d: sum(pieces[w] for w in (t or "").encode().split()) for d, t in docs}


def test_stages_keep_columns_of_any_name(spark):
    from palimpsest.llm import pipeline

    schema = table(spark, DATA, "documents").schema
    names = ["__id", "__own", "__rid", "__spans", "__may", "__bits", "row", "key", "rid", "spans", "cluster"]
    words = " ".join(f"w{i} of a sentence that is fine" for i in range(40))
    base = [(i, words + f" end{i}", "en", "s", 9, *names) for i in range(3)] + [(7, "The other text is quite unlike the rest of them. " * 9, "en", "s", 9, *names)]
    df = spark.createDataFrame(base, schema.simpleString()[7:-1].replace(":", " ") + ", " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in pipeline.STAGES[1:-1]:
        df = stage(spark, df, DATA)
        assert df.columns == schema.names + names, name
    assert sorted(r.doc_id for r in df.collect()) == [0, 7] and {tuple(r)[5:] for r in df.collect()} == {tuple(names)}
