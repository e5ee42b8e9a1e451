"""Intermediate tables in the folder that driver and executors share, and exact positions without one task per key."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillspark-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, local runs (tests) get a temporary folder and clusters raise."""
    path = _FOLDER.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _local_folder()
    return path.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables written inside, deleted at the end; whatever is to stay is written elsewhere."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        _delete(spark, folder)


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder (or another one) and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing needs any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def with_prefix(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], value: Column | None = None) -> DataFrame:
    """Exact running position of every row within its key, without one task per key.

    ``bucket`` must not decrease along ``order`` within a key and should cut a key into even parts. Adds ``_rank``
    (rows before), ``_before`` (sum of value before) and the key's ``_key_rows`` and ``_key_total``. Only one short
    row per (key, bucket) meets in a window over whole keys; rows meet only those of their own bucket. Rows that tie
    in ``order`` are told apart by nothing else, so callers end ``order`` with enough columns. Keys and bucket must not be null.
    """
    value = F.lit(1).cast("long") if value is None else value
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    parts = [*keys, "_bucket"]
    totals = rows.groupBy(*parts).agg(F.count("*").alias("_n"), F.sum("_value").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(c).alias(f"_o{c}") for c in parts],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_n").over(whole).alias("_key_rows"),
        F.sum("_t").over(whole).alias("_key_total"),
    )
    same = [F.col(c) == F.col(f"_o{c}") for c in parts]
    inside = Window.partitionBy(*parts).orderBy(*order)
    return (
        rows.join(offsets, same)
        .withColumn("_rank", F.col("_n0") + F.row_number().over(inside) - 1)
        .withColumn("_before", F.col("_t0") + F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_bucket", "_value", "_n0", "_t0", *[f"_o{c}" for c in parts])
    )


def hash_buckets(column: str, bits: int) -> Column:
    """The top bits of a 64-bit hash as a bucket number that rises with the signed hash."""
    return F.shiftright(F.col(column), 64 - bits)


def bucket_bits(rows: int, per_bucket: int = 20_000) -> int:
    """Bits for at most about ``per_bucket`` rows in each bucket, and enough buckets for many tasks."""
    return max(8, min(40, (max(rows, 1) // per_bucket).bit_length() + 1))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``number``, the place of each row from 1 in a total order of all rows, found over ranges of the order."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    return with_prefix(ranges, [], F.col("_range"), order).withColumn("number", F.col("_rank") + 1).drop("_range", "_rank", "_before", "_key_rows", "_key_total")
