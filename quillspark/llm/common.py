"""Helpers that several corpus operators share, besides those for tables that the whole library uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import bucket_bits, discard, hash_buckets, materialize, scratch, shared_dir, with_prefix

__all__ = ["bucket_bits", "connected_components", "discard", "free_name", "hash_buckets", "materialize", "read_table", "scratch", "shared_dir", "small_batches", "with_prefix"]


#: Edges that one file of a round's state holds.
EDGES_PER_FILE = 50_000


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones clashes with, whatever their letter case."""
    lower = {c.lower() for c in taken}
    while any(c.startswith(name) for c in lower):
        name = f"_{name}"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable for every id that has an edge: (id, component), by alternating small and large stars.

    edges: (u long, v long) in any direction, repeated or looped edges allowed. Each round attaches neighbours to the
    smallest one known; a hub's neighbours are never gathered, only their minimum is. The small star comes first: an id's
    edges to many smaller ones leave it as one, and what then repeats is gone before edges are taken in both directions. The
    minima are written before they are joined back, so that Spark knows their size: few are broadcast, and with many both
    sides are plain shuffles, of which adaptive execution can split a hub's. Lineage is cut each round by a written table.
    """
    def star(pairs: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        """The rewired pairs, and the written minima that they are read from."""
        low = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "lows")
        out = pairs.join(low, pairs.u == low.k)
        if large:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), low
        return out.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), low

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    def written(df: DataFrame, label: str) -> DataFrame:
        """df written in no more files than its rows need: at most as many as there were edges in any state (minima are fewer)."""
        return materialize(df.coalesce(2 * most // EDGES_PER_FILE + 1), label)

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(pairs)
    most = seen[0]
    for _ in range(max_rounds):
        drawn, first = star(pairs, large=False)
        drawn = written(drawn.where("u <> v").distinct(), "edges")
        following, second = star(both(drawn), large=True)
        following = written(following.where("u <> v").distinct(), "edges")
        for old in (pairs, drawn, first, second):
            discard(old)
        pairs, before, seen = following, seen, mark(following)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # In a settled state every id points at its component's smallest id.
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Hand Python workers at most so many bytes of rows at once in this session (Spark's own bound is 64 MB), so that neither their
    memory nor the executors' buffers depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
