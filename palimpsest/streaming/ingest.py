"""Pages, edges and postings from a stream of documents; after its end, the same as from a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..operators import extraction, graph
from ..sources import paging


class Ingest:
    """Appends each micro-batch to tables under ``path``; documents arrive in order of doc_id.

    ``parts`` holds pieces of pages, so a page that spans batches needs no rewriting; ``offsets`` the tokens so
    far. Folders are named by batch, and a batch that is run again overwrites its own, so every one counts once.
    """

    def __init__(self, spark: SparkSession, path: str, page_size: int = fixed.PAGE_SIZE):
        self.spark, self.path, self.page_size = spark, path, page_size

    def _before(self, batch: int) -> int:
        if batch == 0:
            return 0
        done = self.spark.read.schema("batch long, n long").parquet(f"{self.path}/offsets/*").where(F.col("batch") < batch)
        return int(done.agg(F.sum("n")).first()[0] or 0)

    def add(self, docs: DataFrame, batch: int) -> None:
        pieces = paging.parts(docs, self.page_size, self._before(batch))
        pieces.write.mode("overwrite").parquet(f"{self.path}/parts/{batch}")
        written = self.spark.read.schema(paging.PARTS).parquet(f"{self.path}/parts/{batch}")
        written.agg(F.lit(batch).cast("long").alias("batch"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/offsets/{batch}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def pages(self) -> DataFrame:
        pieces = self.spark.read.schema(paging.PARTS).parquet(f"{self.path}/parts/*")
        return paging.joined_pages(pieces.where(F.col("n") == self.page_size), pieces.where(F.col("n") < self.page_size))

    def graph(self) -> dict[str, DataFrame]:
        found = extraction.triples(self.pages())
        return {"edges": graph.edges(found), "strengths": graph.strengths(found), "postings": graph.postings(found)}


def decayed_scores(events: DataFrame, key: str, amount: str, ts: str, window: str = "1 day", delay: str = "2 days", gamma: float = fixed.GAMMA) -> DataFrame:
    """(key, day, score): amounts of each window, less ``gamma`` of them for each hour to its end; for streams and tables."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    span = F.window(ts, window)
    # The grouping window can't be used within the sum, so ages are taken from the truncated time.
    day_end = F.unix_timestamp(F.date_trunc("day", F.col(ts))) + 86_400
    age = (day_end - F.unix_timestamp(ts)) / 3600
    return late.groupBy(F.col(key).alias("key"), span.alias("w")).agg(F.sum(F.col(amount) * F.pow(F.lit(1 - gamma), age)).alias("score")).select("key", F.col("w.start").alias("day"), "score")
