"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

*Flush.* Each task's rows are a memtable: it is sorted by digest and written as one run of (digest, identifier), with minimum and
maximum of the digest in the file's footer. A flush also writes a bitmap filter over its digests.
*Probe.* A later memtable's digests are looked up in the filters of the flushes before; only those that a filter may have, and those that
occur twice among themselves, can have become hits.
*Compaction.* The runs flushed since the last compaction and its result are merged into one sorted run that keeps, for each digest, the
smallest and the largest identifier and the number of rows. Counts are combined before the shuffle, so a digest of a third of all rows
reaches the merge as one row for each task.
*Byte verification.* A digest held by more than one row is a hit. Hits are found in the texts by a bitmap filter that is
sized to their number (up to 64 MiB; a full filter only costs time), then grouped by digest **and** whole normalised
text, again combined before the shuffle; texts that differ under one digest become classes of their own.

Defined results: a null text counts as empty; a row without identifier stays only if no equal row
has one; repeated rows are members each; an empty table gives an
empty result; other columns are ignored, and kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_for, marked, packed, scratch, texts_of, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, id) in a folder; level 0 as flushed, level 1 compacted."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path, self.runs, self.compacted, self.filters = spark, path or scratch(spark, "digests"), 0, 0, []
        self.level1: DataFrame | None = None

    def _run(self, number: int) -> DataFrame:
        return self.spark.read.schema("digest binary, id long").parquet(f"{self.path}/level0/run={number}")

    def flush(self, rows: DataFrame, filtered: bool = True) -> DataFrame:
        """Write ``rows`` (digest, id) as sorted runs, one for each task, and a filter over them if more flushes follow; no shuffle of rows."""
        number = self.runs
        self.runs += 1
        rows.select("digest", F.col("id").cast("long").alias("id")).sortWithinPartitions("digest").write.parquet(f"{self.path}/level0/run={number}")
        run = self._run(number)
        if filtered:
            bits = bits_for(run.count())
            self.filters.append((written(bitmap(run, "digest", bits), "filter"), bits))
        return run

    def hits(self, rows: DataFrame) -> DataFrame:
        """(digest): of a memtable not yet flushed, digests that it has twice or that a run or the compacted level has; exact."""
        may = rows.select("digest").withColumn("any", F.lit(False))
        for filter_, bits in self.filters:
            may = marked(may, filter_, F.col("digest"), "here", bits).select("digest", (F.col("any") | F.col("here")).alias("any"))
        own = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        doubtful = may.where("any").select("digest").distinct()
        old = [self._run(k).select("digest") for k in range(self.compacted, self.runs)] + ([self.level1.select("digest")] if self.level1 is not None else [])
        found = own
        for level in old:
            found = found.unionByName(doubtful.join(level, "digest", "left_semi"))
        return found.distinct()

    def compact(self) -> DataFrame:
        """Merge the runs flushed since the last compaction, and its result, into a new level 1: (digest, low, high, n)."""
        if self.level1 is not None and self.compacted == self.runs:
            return self.level1
        runs = self.level1
        for number in range(self.compacted, self.runs):
            run = self._run(number).select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n"))
            runs = run if runs is None else runs.unionByName(run)
        if runs is None:
            raise ValueError("nothing was flushed")
        merged = runs.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        target = f"{self.path}/level1-{self.runs}"
        merged.sortWithinPartitions("digest").write.parquet(target)
        self.compacted, self.level1 = self.runs, self.spark.read.schema("digest binary, low long, high long, n long").parquet(target)
        return self.level1


def classes(docs: DataFrame, *, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest or the largest identifier of equal texts stays. Of repeated rows that share that
    identifier, each is marked as kept: they can't be told apart.
    """
    texts = texts_of(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("ntext"))
    digested = texts.select("doc_id", "ntext", digest_of(F.col("ntext")).alias("digest"))
    index = DigestIndex(docs.sparkSession)
    run = index.flush(digested.select("digest", F.col("doc_id").alias("id")), filtered=False)  # no other memtable follows
    merged = index.compact()

    # Byte verification of the hits.
    hits = merged.where("n > 1")
    bits = bits_for(hits.count())
    verified = (
        marked(digested, bitmap(hits, "digest", bits), F.col("digest"), "may", bits)
        .where("may")
        .groupBy("digest", "ntext")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    )
    path = f"{index.path}/verified"
    verified.write.parquet(path)
    verified = docs.sparkSession.read.schema("digest binary, ntext string, low long, high long, n long").parquet(path)
    stays = F.col("high" if keep == "largest" else "low")
    out = [F.col("id").alias("doc_id"), stays.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(stays).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    # Digests that more than one text has: with SHA-256 none are known. Only their rows need their texts again.
    torn = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if torn.isEmpty():
        return run.join(merged, "digest").select(*out)
    whole = run.join(torn, "digest", "left_anti").join(merged, "digest")
    split = digested.withColumnRenamed("doc_id", "id").join(torn, "digest", "left_semi").join(verified, ["digest", "ntext"])
    return whole.select(*out).unionByName(split.select(*out))


def keep_one(docs: DataFrame, *, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows that have an equal text elsewhere; all columns stay.

    Texts that stay don't move, but for those that share a bit of the filter with one that goes. Repeated rows that share
    identifier and text count as one; one of them stays.
    """
    every = written(classes(docs, keep=keep, id_col=id_col, text_col=text_col).select("doc_id", "kept", "group_size", F.unhex("text_sha256").alias("digest")), "classes")
    named = [F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")]
    own = digest_of(normalised(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    gone = written(every.where(~F.col("kept")).select(*named).distinct(), "gone")
    repeated = written(every.where("kept AND group_size > 1").groupBy("doc_id", "digest").count().where("count > 1").select(*named), "repeated")
    if repeated.isEmpty():
        return without(docs, gone, id_col, own)
    once = without(docs, gone.unionByName(repeated), id_col, own)
    same = F.col("key").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__digest"))
    again = packed(docs, key=docs[id_col].cast("long"), own=own).join(repeated, same, "left_semi")
    return once.unionByName(again.groupBy("key", "own").agg(F.first("row").alias("row")).select("row.*"))
