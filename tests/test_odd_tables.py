"""Registered queries on small tables of an unusual kind, against their SQL."""

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.llm import suffix_dedup
from palimpsest.operators import compression, graph, retrieval, search
from palimpsest.plans import registry
from palimpsest.sources import paging


def agrees(spark, name, sf_dir):
    return compare(spark, registry.QUERIES[name], registry.ORACLES[name], str(sf_dir))


def test_pages_without_terms(spark, tmp_path):
    texts = ["ab cd " * 500, "word other " * 300, "x " * 2000]  # short words alone fill the first and the last pages
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert agrees(spark, "page_embedding", tmp_path) == 16


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Many equal vectors, others that point the same way, and near ones."""
    path, draw = tmp_path_factory.mktemp("vectors"), np.random.RandomState(1)
    x = draw.randn(700, 64).astype("float32") / 8
    x[100:300] = x[100]
    x[300:320] = x[100] * 2
    x[400:420] = x[50] + draw.randn(20, 64).astype("float32") / 100
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["cosine_topk", "rbf_proximity", "bucket_miss_candidates"])
def test_equal_vectors_in_blocks(spark, vectors, monkeypatch, name):
    monkeypatch.setattr(search, "ASKED_BLOCK", 5)
    monkeypatch.setattr(search, "ROWS", 64)
    monkeypatch.setattr(search, "TILE", 256)
    assert agrees(spark, name, vectors) > 0
    plan = registry.QUERIES[name](spark, str(vectors))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # no row for each pair but in the result


def test_is_concept_by_words(spark):
    texts = ["ab", "a", "a b", "été x", "a1 b2", "ab1", "x　ab\x1c9", "ab ", "a.b cd.", "\U00010400\U00010401 1", "", "日本", "1 ab"]
    want = [len(t) >= 2 and any(len(w) >= 2 and w.isalpha() for w in t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.c for r in df.orderBy("i").select(text.is_concept(F.col("t")).alias("c")).collect()] == want


def test_texts_move_once_to_become_pages(spark, tmp_path):
    """Only pieces of pages that blocks share are grouped; a text is split nowhere but in blocks."""
    docs = spark.createDataFrame([(i % 7, f"w{i} " * (i % 5) + "　z") for i in range(400)], "doc_id long, text string").repartition(6)
    plan = paging.pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("hashpartitioning(page_seq") == 1 and "Join" in plan and "SortMergeJoin" not in plan


def test_triples_are_made_once(spark):
    """What numbers concepts is written before it is read twice."""
    found = spark.createDataFrame([(0, 1, "a", "is", "b")], "page_seq long, ord long, subject string, predicate string, object string")
    plan = graph.concepts(found)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_found_words_go_on_as_they_come(spark, monkeypatch):
    """A batch of pages gives many small batches of rows, not one."""
    pages = spark.createDataFrame([(i, f"page_{i}", f"Alpha beta{i % 3} gamma " * 3) for i in range(50)] + [(50, "page_50", "")], "page_seq long, page_id string, text string").coalesce(1)
    words = {"a": ["alpha", "beta1"], "b": ["beta2", "mm"], "c": [], "d": ["a"]}
    monkeypatch.setattr(retrieval, "FOUND_ROWS", 7)
    held = retrieval.held_words(pages, words)
    assert "MapInArrow" in held._jdf.queryExecution().executedPlan().toString()
    want = {(q, i): n for i in range(50) for q, own in words.items() if (n := sum(w in f"alpha beta{i % 3} gamma" for w in own))}
    assert {(r.query_id, r.page_seq): r.n for r in held.collect()} == want
    assert retrieval.held_words(pages, {}).count() == 0


def test_shared_words_without_a_row_for_each_pair(spark):
    concepts = spark.createDataFrame([(c,) for c in ("the of", "the", "the cat", "House", "house cat the", "é the", "")], "concept string")
    queries = spark.createDataFrame([("a", "The cat of the HOUSE"), ("b", "the the"), ("c", ""), ("d", None)], "query_id string, query string")
    found = retrieval.lexical_concepts(concepts, queries)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "House"), ("a", "house cat the"), ("a", "the cat"), ("a", "the of")]


def test_marks_of_many_blocks_are_sorted_once(monkeypatch):
    """Of op5's merge: the work on marks doesn't grow with the number of blocks."""
    draw = np.random.RandomState(2)
    source, windows = draw.randint(0, 2000, 5000).astype("int32"), draw.randint(0, 40, 5000)
    got = {s: [w for a, b in zip(first.tolist(), last.tolist(), strict=True) for w in range(a, b + 1)] for s, first, last in suffix_dedup._stretches(source, windows)}
    assert got == {s: sorted(set(windows[source == s].tolist())) for s in set(source.tolist())}
    assert list(suffix_dedup._stretches(source[:0], windows[:0])) == []


def test_near_pairs_in_strips(spark, monkeypatch):
    monkeypatch.setattr(compression, "BLOCK_ROWS", 40)
    monkeypatch.setattr(compression, "STRIP", 3)
    x = np.random.RandomState(4).randn(150, 8)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.5), strict=True) if i < j}
    got = [(r.a, r.b) for r in compression.near_pairs(table, 8, 0.5, w=1e6).collect()]
    assert set(got) == want and len(got) == len(want)
