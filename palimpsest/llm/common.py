"""What the operators share: scratch folders, written tables, and rows without clashing names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not those that made it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df.scratch_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under fixed names; a null text counts as empty."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a bitmap filter over keys: rows of 4 KiB; 1 MiB unless the keys are counted first, then BITS_A_KEY for each within bounds. A full one only costs time.
FILTER_BITS, ROW_BITS = 1 << 23, 1 << 15
BITS_A_KEY, MOST_BITS = 16, 1 << 29


def bits_for(n: int) -> int:
    """Length of a filter of ``n`` keys: a power of two from FILTER_BITS to MOST_BITS (64 MiB)."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_A_KEY * max(1, n) - 1).bit_length()))


def bit_position(key: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, bits): a filter over a column; at most ``bits`` / ROW_BITS rows."""
    at = bit_position(F.col(column), bits)
    return keys.groupBy(F.floor(at / ROW_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(ROW_BITS))).alias("bits"))


def marked(rows: DataFrame, filter_: DataFrame, key: Column, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a column that is false where the filter can't have the key; broadcasts the filter, whose size is bounded.

    ``rows`` must have no columns called __bucket, __bits or ``flag``."""
    at = bit_position(key, bits)
    bit = F.pmod(at, F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.col("__bits").substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    named = filter_.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    joined = rows.join(F.broadcast(named), F.floor(at / ROW_BITS) == F.col("__bucket"), "left")
    set_ = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return joined.withColumn(flag, F.coalesce(set_, F.lit(False))).drop("__bucket", "__bits")


def packed(rows: DataFrame, **more: Column) -> DataFrame:
    """(row, ...): all columns of ``rows`` in one struct, so that what is added beside it can't clash with them."""
    return rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def without(rows: DataFrame, gone: DataFrame, id_col: str, digest: Column | None = None) -> DataFrame:
    """``rows`` less those that match a row of ``gone`` (__id, and __digest if ``digest`` is given); all columns stay.

    Rows that a filter over __id lets pass never move; the others, few unless the filter is full, meet ``gone`` in a join.
    """
    bits = bits_for(gone.count())
    flagged = marked(packed(rows, key=rows[id_col].cast("long"), **({} if digest is None else {"own": digest})), bitmap(gone, "__id", bits), F.col("key"), "may", bits)
    same = F.col("key").eqNullSafe(F.col("__id"))
    left = flagged.where("may").join(gone, same if digest is None else same & (F.col("own") == F.col("__digest")), "left_anti")
    return flagged.where("NOT may").select("row.*").unionByName(left.select("row.*"))


def _give_back() -> None:
    """Idle workers stay until the next stage; their memory is the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(run):
    """A function for mapInArrow or mapInPandas that gives memory back when its partition is done."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        _give_back()

    return wrapped
