import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup


def brute(rows, keep):
    lower = {i: c for i, c in zip(map(ord, exact_dedup.UPPER), exact_dedup.LOWER, strict=True)}
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(lower)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (min if keep == "smallest" else max)(known) if known else None
        out += [(i, stays, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (7, "x" * 200_000), (None, "a b"), (None, "only"), (9, "A\tb")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    df = spark.createDataFrame([(*r, "x", b"y") for r in ROWS], "doc_id long, text string, id string, digest binary")
    got = exact_dedup.classes(df, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, keep)


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)))
    rows = [(i, f"text {i % 400}") for i in range(1200)]
    got = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in brute(rows, "smallest"))


def test_empty_table(spark):
    assert exact_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_compaction_of_several_flushes(spark):
    index = exact_dedup.DigestIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "digest binary, id long")
    index.flush(frame([(b"a", 5), (b"b", 1)]))
    index.flush(frame([(b"a", 2), (b"c", 9)]))
    got = {bytes(r.digest): (r.low, r.high, r.n) for r in index.compact().collect()}
    assert got == {b"a": (2, 5, 2), b"b": (1, 1, 1), b"c": (9, 9, 1)}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_dedup.classes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_two_rounds_of_flushing_and_compacting(spark):
    rows = lambda *x: spark.createDataFrame([(d.encode(), i) for d, i in x], "digest binary, id long")
    index = exact_dedup.DigestIndex(spark)
    for turn, (memtable, hits) in enumerate([([("a", 1), ("b", 2), ("b", 3)], {"b"}), ([("a", 9), ("c", 4)], {"a"}), ([("c", 5), ("d", 6)], {"c"}), ([("e", 7), ("b", 0)], {"b"})]):
        assert {bytes(r.digest).decode() for r in index.hits(rows(*memtable)).collect()} == hits
        index.flush(rows(*memtable))
        if turn == 1:
            assert {(bytes(r.digest).decode(), r.low, r.high, r.n) for r in index.compact().collect()} == {("a", 1, 9, 2), ("b", 2, 3, 2), ("c", 4, 4, 1)}
    want = {("a", 1, 9, 2), ("b", 0, 3, 3), ("c", 4, 5, 2), ("d", 6, 6, 1), ("e", 7, 7, 1)}
    for _ in range(2):  # nothing is counted twice
        assert {(bytes(r.digest).decode(), r.low, r.high, r.n) for r in index.compact().collect()} == want


def test_filters_follow_the_number_of_keys(spark):
    from palimpsest.llm import common

    assert common.bits_for(0) == common.FILTER_BITS and common.bits_for(10**7) == 1 << 28 and common.bits_for(10**12) == common.MOST_BITS
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    bits = 1 << 25
    seen = common.marked(spark.range(3000).select(F.col("id").cast("string").alias("k")), common.bitmap(keys, "k", bits), F.col("k"), "may", bits)
    assert seen.where("k < 0 OR (cast(k AS int) < 1000 AND NOT may)").count() == 0 and seen.where("cast(k AS int) >= 1000 AND may").count() < 5


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "__own", "__id", "__may", "__bits", "row", "key", "own", "may", "a.b"]
    rows = [(1, "A", *"123456789"), (2, "a", *"123456789"), (2, "a", *"123456789"), (3, "b", *"123456789")]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = exact_dedup.keep_one(df, keep="largest")
    assert got.columns == names and sorted(map(tuple, got.collect())) == [rows[1], rows[3]]
