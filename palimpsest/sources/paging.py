"""A document stream cut into pages of so many tokens, whatever the documents' ends.

Documents come in order of doc_id, a null one first; those that share an identifier in a fixed order, by the hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .store import kept

#: Characters of a block of the stream, and tokens of a text that are added to it at a time.
BLOCK_CHARS, BLOCK_TOKENS = 1 << 20, 1 << 17


def running_starts(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``counts`` with a column start: the sum of ``n`` over all rows that come before by ``keys``, which tell rows apart.

    Rows are dealt out by ranges of their keys, as many to each, whatever the keys' distances. Sums are taken within ranges and over the
    ranges' totals; only these, one row for each partition, are ever in one task.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = kept(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "ranged")
    totals = ranged.groupBy("__part").agg(F.sum(n).alias("__total"))
    before = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__before"))
    within = F.sum(n).over(Window.partitionBy("__part").orderBy("__place")) - F.col(n)
    joined = ranged.withColumn("__within", within).join(F.broadcast(before), "__part")
    return joined.withColumn("start", F.col("__before") + F.col("__within")).drop("__part", "__place", "__before", "__within")


BLOCK = "part int, before long, n long, tokens string"
PARTS = "page_seq long, start long, n int, part string"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of tokens of a partition's texts, in order; ``before``: the partition's tokens before a block's."""
    part, held, chars, n, before = TaskContext.get().partitionId(), [], 0, 0, 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": [before], "n": [n], "tokens": [" ".join(held)]})

    for batch in batches:
        for value in batch.column(0):
            tokens = (value.as_py() or "").split()
            for a in range(0, len(tokens), BLOCK_TOKENS):
                some = tokens[a : a + BLOCK_TOKENS]
                held.append(" ".join(some))
                n, chars = n + len(some), chars + len(held[-1])
                if chars >= BLOCK_CHARS:
                    yield block()
                    held, chars, n, before = [], 0, 0, before + n
    if n:
        yield block()


def token_blocks(docs: DataFrame) -> DataFrame:
    """(start, n, tokens): the stream in blocks of BLOCK_CHARS or so, tokens single-spaced; ``start`` counts those before.

    Texts move once, to the range of their keys; copies of a row differ in a third key, so that no key holds more than a range.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("copy")]
    rows = docs.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("copy"), "text")
    blocks = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("text").mapInArrow(_packed, BLOCK), "blocks")
    totals = blocks.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each partition
    ahead = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    return blocks.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("before")).alias("start"), "n", "tokens")


def _cut(page_size: int, begin: int, whole: bool, broken: bool):
    """Pieces of pages that lie within blocks: whole pages, and what is left before the first and after the last of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, text_ in zip(*batch.columns, strict=True):
                start, n, text_ = start.as_py() + begin, n.as_py(), text_.as_py()
                head = min(n, -start % page_size)
                tail = (start + n) % page_size if head < n else 0
                if whole:
                    tokens = text_.split(" ")
                    edges = [(a, min(a + page_size, n)) for a in range(head, n, page_size)]
                    pieces = [(a, b, " ".join(tokens[a:b])) for a, b in edges if b - a == page_size or broken]
                    if head and broken:
                        pieces.append((0, head, " ".join(tokens[:head])))
                else:
                    pieces = [(0, head, " ".join(text_.split(" ", head)[:head]))] if head else []
                    pieces += [(n - tail, n, " ".join(text_.rsplit(" ", tail)[-tail:]))] if tail else []
                first, last, parts_ = zip(*pieces, strict=True) if pieces else ((), (), ())
                starts = [start + a for a in first]
                yield pa.RecordBatch.from_pydict({"page_seq": pa.array([s // page_size for s in starts], pa.int64()), "start": pa.array(starts, pa.int64()), "n": pa.array([b - a for a, b in zip(first, last, strict=True)], pa.int32()), "part": pa.array(parts_, pa.string())})

    return cut


def parts(docs: DataFrame, page_size: int = fixed.PAGE_SIZE, start: int = 0) -> DataFrame:
    """(page_seq, start, n, part): the tokens that each block of the stream gives to each page; ``start`` tells their order.

    ``start``: tokens that earlier input has filled already.
    """
    return token_blocks(docs).mapInArrow(_cut(page_size, start, True, True), PARTS)


def joined_pages(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """(page_seq, page_id, text, token_count) of whole pages, and of pieces of the others; the last page may be short. Only pieces move."""
    parted = F.array_sort(F.collect_list(F.struct("start", "part")))
    joined = pieces.groupBy("page_seq").agg(F.array_join(F.transform(parted, lambda p: p["part"]), " ").alias("text"), F.sum("n").cast("int").alias("token_count"))
    every = whole.select("page_seq", F.col("part").alias("text"), F.col("n").alias("token_count")).unionByName(joined)
    return every.select("page_seq", text.beacon_id("page", F.col("page_seq")).alias("page_id"), "text", "token_count")


def pages(docs: DataFrame, page_size: int = fixed.PAGE_SIZE, start: int = 0) -> DataFrame:
    """Pages of (doc_id, text): (page_seq, page_id, text, token_count)."""
    blocks = token_blocks(docs)
    return joined_pages(blocks.mapInArrow(_cut(page_size, start, True, False), PARTS), blocks.mapInArrow(_cut(page_size, start, False, True), PARTS))
