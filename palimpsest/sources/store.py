"""Tables of an index or entity store in a folder, validated when read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The named tables; FileNotFoundError for a missing one, ValueError for one without an expected column."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise FileNotFoundError(f"{path}/{name}") from e
        if missing := set((columns or {}).get(name, [])) - set(out[name].columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
    return out


def check_graph(tables: dict[str, DataFrame]) -> None:
    """Every end of an edge has to be a concept."""
    ends = tables["edges"].select(F.col("src").alias("concept")).unionByName(tables["edges"].select(F.col("dst").alias("concept")))
    if not ends.join(tables["concepts"], "concept", "left_anti").isEmpty():
        raise ValueError("edges with ends that are no concepts")


def page_texts(pages: DataFrame, page_ids: list[str]) -> DataFrame:
    """A point read: the filter reaches the Parquet scan."""
    return pages.where(F.col("page_id").isin(page_ids)).select("page_id", "text")


def reads(page_ids: DataFrame, delta: float = 1.0) -> DataFrame:
    """Rows for the access log."""
    return page_ids.select("page_id", F.lit(delta).alias("delta"))


def cache_fill(pages: DataFrame, capacity: int) -> DataFrame:
    n = F.count("*")
    return pages.agg(n.alias("total"), F.least(F.lit(1.0), n / capacity).alias("fill"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a machine's own will do only where all executors are on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "palimpsest")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: computed once however often it is used, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``kept`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
