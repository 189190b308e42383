import zlib

import numpy as np
import pytest

from palimpsest.llm import quality
from palimpsest.llm.common import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"), max_labelled=200)


def brute(text, model):
    """The same vote, one text and one neighbour at a time."""
    row = quality.weighted(quality.counted([text]), model.idf)[0] @ model.axes
    row = row / max(np.linalg.norm(row), 1e-12)
    cos = sorted(((float(row @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: model.neighbours]
    weights = [np.exp(quality.SHARPNESS * (c - cos[0][0])) if c > 0 else 0 for c, _ in cos]
    return sum(w * y for w, (_, y) in zip(weights, cos, strict=True)) / sum(weights) if sum(weights) else model.prior


def test_held_out_accuracy(spark, model):
    scored = {r.doc_id: r for r in quality.score(table(spark, DATA, "documents"), model).collect()}
    assert len(scored) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    tests = [(scored[r.doc_id].predicted, r.quality) for r in table(spark, DATA, "labels").collect() if scored[r.doc_id].held_out]
    assert np.mean([p == q for p, q in tests]) >= 0.95
    assert np.mean([p == 0 for p, q in tests if q == 0]) >= 0.8


def test_votes_against_brute_force(spark, model):
    texts = [r.text.encode() for r in table(spark, DATA, "documents").limit(60).collect()] + [b"", b"\x00", "é".encode() * 90_000]
    assert np.allclose(model.score(texts), [brute(t, model) for t in texts], atol=1e-4)


def test_learns_from_the_other_folds_only(spark):
    docs = spark.createDataFrame([(i, f"Some text, no {i}.") for i in range(60)], "doc_id long, text string")
    marks = lambda q: spark.createDataFrame([(i, q(i), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    flip = lambda i: int(zlib.crc32(str(i).encode()) % 3 == 1)
    a, b = quality.fit(docs, marks(lambda i: i % 2)), quality.fit(docs, marks(lambda i: 1 - i % 2 if flip(i) else i % 2))
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)


def test_edges(spark, model):
    rows = [(1, None, "s"), (1, None, "s"), (None, "Words here.", "t"), (2, "", "u"), (3, "THE!! " * 40_000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score(df.limit(0), model).count() == 0
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(df, quality.fit(df, none)).collect()] == [0.5] * 5
    assert quality.fit(df.limit(0), none).prior == 0.5
