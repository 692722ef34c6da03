"""What the operators share: table access, rows by id, bucketed running sums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.storage import settle, shared_dir, unsettle

__all__ = ["BUCKET_ROWS", "aside", "buckets_for", "components", "keeps", "one_per_id", "release", "running", "settle", "shared_dir", "small_batches", "table", "texts", "unsettle"]

#: White space of the word rules: a space and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a bucket of a running sum.
BUCKET_ROWS = 20_000
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names, in any case, renamed, and how to rename them back."""
    back = {f"__aside_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({v: k for k, v in back.items()}), back


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python BATCH_ROWS at a time at most from now on in this session: texts can be long, and workers share an
    executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_kept: list[Callable] = []


def keeps(f: Callable) -> Callable:
    """For functions with a cache that workers keep from task to task of one operator: release() of any other one clears it."""
    _kept.append(f)
    return f


def release(own: Callable | None = None) -> None:
    """Gives memory that a worker's task no longer uses back to the system: workers stay, beside others and the JVM. What
    they keep of other operators than that of own goes too."""
    for f in _kept:
        if f is not own:
            f.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim:
        trim(0)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text), one row for each id: rows without an id are left out, of rows that share an id the
    greatest text stays (so repeated rows count once), null texts become empty."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .where(F.col("doc_id").isNotNull())
    )


def one_per_id(docs: DataFrame) -> DataFrame:
    """texts() with one row for each id. Ids that occur once, nearly all, take no part in the choice of a text."""
    small_batches(docs.sparkSession)
    rows = texts(docs)
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_id")
    if not shared.take(1):
        return rows
    lone = rows.join(shared, "doc_id", "left_anti")
    return lone.unionByName(rows.join(shared, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")))


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str, buckets: int) -> DataFrame:
    """df with a column: the sum of amount over earlier rows of the same keys. The order within keys is by bucket
    (a hash of the order columns), then by the order columns, which must tell rows apart. No task gets all rows of a key:
    sums of the buckets, a small table, are added up first."""
    from pyspark.sql import Window

    cut = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("__a", amount.cast("long"))
    local = Window.partitionBy(*keys, "__b").orderBy(*order)
    sums = cut.groupBy(*keys, "__b").agg(F.sum("__a").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inner = F.sum("__a").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__a")
    return cut.withColumn("__i", inner).join(sums, [*keys, "__b"]).withColumn(name, F.col("__i") + F.col("__o")).drop("__b", "__a", "__i", "__o")
