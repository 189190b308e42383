import sys
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_bpe as bpe_test  # noqa: E402
import test_decontaminate as dec_test  # noqa: E402
import test_similar_groups as near_test  # noqa: E402

import corpus_pipeline  # noqa: E402
from palimpsest.llm import bpe, exact_dedup, quality  # noqa: E402
from palimpsest.llm.common import table  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]


def test_run_against_plain_stages(spark):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    scores = quality.score(table(spark, DATA, "documents"), quality.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))).collect()
    docs = {r.doc_id: docs[r.doc_id] for r in scores if r.predicted}
    lower = {ord(a): b for a, b in zip(exact_dedup.UPPER, exact_dedup.LOWER, strict=True)}
    last = {}
    for i, t in docs.items():
        last[t.translate(lower)] = max(i, last.get(t.translate(lower), i))
    docs = {i: docs[i] for i in last.values()}
    kept = {i for i, c in near_test.brute(sorted(docs.items())) if i == c}  # five words, four fifths: exact Jaccard similarities of all pairs
    docs = {i: t for i, t in docs.items() if i in kept}
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    left = {i: plain_cut(t, items) for i, t in docs.items()}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: len(bpe.encode_text(t, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)) for i, t in left.items()}
    assert bpe_test.RANKS == P.path("byte_bpe_multi_50k.tiktoken")


def plain_cut(text, items):
    words = list(dec_test.WORD.finditer(lowered := dec_test.lower(text)))
    windows = set()
    for _, item in items:
        w = dec_test.WORD.findall(dec_test.lower(item or ""))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    hit = [False] * len(words)
    for i in range(len(words)):
        for n in sizes:
            if tuple(m[0] for m in words[i : i + n]) in windows and i + n <= len(words):
                hit[i : i + n] = [True] * n
    assert len(lowered) == len(text)
    out, at, i = [], 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j < len(words) and hit[j]:
                j += 1
            out.append(text[at : words[i].start()])
            at, i = words[j - 1].end(), j
        else:
            i += 1
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_one_of_equal_texts_stays(spark, keep):
    rows = [(1, "A"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "d"), (6, "D")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __id string, n_chars int")
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_one(df.drop("__id"), keep=keep).collect()), key=str)
    want = {"smallest": [(1, "A"), (3, None), (None, "b"), (5, "c"), (5, "d")], "largest": [(2, "a"), (4, ""), (None, "b"), (5, "c"), (6, "D")]}[keep]
    assert got == sorted(want, key=str)


def test_stages_take_empty_and_odd_tables(spark):
    schema = table(spark, DATA, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "Words. " * 30_000, "en", "s", 9)], schema)
    for docs in (spark.createDataFrame([], schema), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where(F.col("n_tokens") < 0).count() == 0
