import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from palimpsest.llm import pipeline as corpus_pipeline  # noqa: E402
from palimpsest.llm import simhash  # noqa: E402
from palimpsest.llm.common import table  # noqa: E402


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    found = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (found[i] == found[j] or 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]) > 0):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    lows = {}
    for (d, _), r in zip(rows, root, strict=True):
        lows[r] = min((x for x in (lows.get(r), d) if x is not None), default=None)
    return sorted(((d, lows[r]) for (d, _), r in zip(rows, root, strict=True)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        words = list(rng.choice(vocabulary, 120))
        for k in range(8):  # a chain: ends are less alike than neighbours
            rows.append((100 * i + k, " ".join(words)))
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(0, 120)] = f"changed{rng.integers(0, 9)}"
    line = " ".join(vocabulary[:12])  # all share a line
    rows += [(5000 + i, line + " " + " ".join(rng.choice(vocabulary, 40))) for i in range(40)]
    rows += [(9001, None), (9002, ""), (9003, "one"), (9003, "ONE"), (None, "two words"), (9006, "two words"), (None, "alone")]
    edge = [f"e{i}" for i in range(14)]  # ten shingles; eight of ten and twelve in common are four fifths of neither
    rows += [(9100, " ".join(edge)), (9101, " ".join(edge[:12])), (9102, " ".join(edge[:11]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    assert sorted(map(tuple, simhash.similar_groups(df).collect()), key=str) == brute(rows)


def test_stage_removes_the_near_copies_of_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").select("doc_id").collect())
    assert kept == [d for d, low in sorted(brute(rows)) if d == low]
    assert not {145, 177} & set(kept)  # five-word similarity of 0.83 to 6 and 1; 7 and 11 bits of SimHash apart


def test_empty_table(spark):
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
