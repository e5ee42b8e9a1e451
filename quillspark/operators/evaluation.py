"""Measures of retrieval quality and latency as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def separation(measured: DataFrame, threshold: float) -> DataFrame:
    """One row over (kind, distance, bm25): the outermost values of relevant and out-of-domain questions, and the verdict."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    out = measured.agg(
        F.max(of("relevant", "distance")).alias("max_relevant"),
        F.min(of("out_of_domain", "distance")).alias("min_out_of_domain"),
        F.max(of("out_of_domain", "bm25")).alias("max_out_bm25"),
        F.min(of("relevant", "bm25")).alias("min_relevant_bm25"),
    )
    return out.withColumn("separated", (F.col("max_relevant") <= threshold) & (F.col("min_out_of_domain") > threshold))


def verdict(results: DataFrame) -> DataFrame:
    """One row over (kind, n_hits, expected_found): relevant questions lost, out-of-domain ones leaked, citations missing."""
    relevant = F.col("kind") == "relevant"
    out = results.agg(
        F.count_if(relevant & (F.col("n_hits") == 0)).alias("lost"),
        F.count_if((F.col("kind") == "out_of_domain") & (F.col("n_hits") > 0)).alias("leaked"),
        F.count_if(relevant & (F.col("n_hits") > 0) & ~F.coalesce("expected_found", F.lit(True))).alias("missing"),
    )
    return out.withColumn("passed", (F.col("lost") == 0) & (F.col("missing") == 0))


def nearest_rank(value: Column | str, q: float) -> Column:
    """The observed value at rank ceil(q * n)."""
    name = value if isinstance(value, str) else None
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {name})")


def latency(samples: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    """Median, nearest-rank percentiles and counts per group."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.median(seconds).alias("median"), *[nearest_rank(seconds, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)], F.avg(seconds).alias("mean")
    )


def failures(samples: DataFrame, reason: str) -> DataFrame:
    """(reason, n), the most frequent first."""
    return samples.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), reason)


def expected_found(citations: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, expected_found): whether any citation of a question contains its expected text."""
    return citations.join(expected, "query_id").groupBy("query_id").agg(F.bool_or(F.contains("citation", F.col("expected"))).alias("expected_found"))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, rank_before, rank_after) by key."""
    return before.select("query_id", "id", F.col("position").alias("rank_before")).join(after.select("query_id", "id", F.col("position").alias("rank_after")), ["query_id", "id"])


def report(statuses: DataFrame, by: str, status: str, item: str) -> DataFrame:
    """Per group and status the number of items and the first one; ``statuses`` itself is the list of them."""
    return statuses.groupBy(by, status).agg(F.count("*").alias("n"), F.min(F.col(item).cast("string")).alias("first"))


def translation_worked(asked: DataFrame) -> DataFrame:
    """One row: whether any question was searched in other words than its own (question, query)."""
    return asked.agg(F.coalesce(F.bool_or(F.col("query") != F.col("question")), F.lit(False)).alias("worked"))
