"""Okapi BM25 over character bigrams.

The index of a corpus is one row per document (id, len, tokens, tfs): its distinct tokens and how often it holds each, made in one
pass over the texts and written once. Postings, lengths and statistics are read off it, and a batch of queries probes it with
one join on the token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigram_text, bigrams, counted_bigrams, nfkc

K1, B = 1.2, 0.75


def tokens(corpus: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, tokens array) of the NFKC form of each text, repeats included."""
    return corpus.select(F.col(id_col).alias("id"), bigrams(nfkc(F.coalesce(F.col(text), F.lit("")))).alias("tokens"))


def index(corpus: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, len, tokens, tfs) of each document; null texts have no tokens."""
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                starts, codes, counts = counted_bigrams([x or "" for x in batch.column("text").to_pylist()])
                distinct, which = np.unique(codes, return_inverse=True)
                names = pa.array([bigram_text(c) for c in distinct.tolist()], pa.string())
                offsets, sums = pa.array(starts.astype("i4")), np.concatenate(([0], np.cumsum(counts)))
                columns = [
                    batch.column("id"),
                    pa.array(np.diff(sums[starts]).astype("i4")),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(which))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype("i4"))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "len", "tokens", "tfs"])

    return rows.mapInArrow(run, f"id {kind}, len int, tokens array<string>, tfs array<int>")


def lengths(indexed: DataFrame) -> DataFrame:
    """(id, len), of an index or of token arrays."""
    return indexed.select("id", F.col("len") if "len" in indexed.columns else F.size("tokens").alias("len"))


def postings(indexed: DataFrame) -> DataFrame:
    """(token, id, tf). An index has the counts already; token arrays are counted, combined on the map side."""
    if "tfs" in indexed.columns:
        return indexed.select("id", F.explode(F.arrays_zip("tokens", "tfs")).alias("p")).select(F.col("p.tokens").alias("token"), "id", F.col("p.tfs").cast("long").alias("tf"))
    return indexed.select("id", F.explode("tokens").alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def statistics(lens: DataFrame) -> DataFrame:
    """One row (n, average): empty documents count; an empty corpus has average 1."""
    return lens.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("average"))


def idf(df: Column, n: Column) -> Column:
    return F.when(df > 0, F.ln(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def document_frequency(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf): a token's documents are counted on the map side and never travel."""
    counted = posts.groupBy("token").agg(F.count("*").alias("df"))
    return counted.crossJoin(stats.select("n")).select("token", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def scores(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents that share a token with a query (query_id, text).

    Repeated query tokens add repeatedly. ``indexed`` is read three times (statistics, frequencies, scores), so a large one is
    written first. Its exploded side only meets what comes from the queries' own tokens.
    """
    asked = queries.select(F.col("query_id"), F.explode(bigrams(nfkc(F.coalesce("text", F.lit(""))))).alias("token"))
    wanted = asked.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    stats = statistics(lengths(indexed))
    posts = postings(indexed)
    frequency = posts.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    # The statistics are one row, so this join is with a constant.
    weight = wanted.join(frequency, "token").crossJoin(stats).select("query_id", "token", "qtf", "average", idf(F.col("df"), F.col("n")).alias("idf"))
    sized = posts.join(lengths(indexed), "id") if "tfs" not in indexed.columns else indexed.select("id", "len", F.explode(F.arrays_zip("tokens", "tfs")).alias("p")).select("id", "len", F.col("p.tokens").alias("token"), F.col("p.tfs").alias("tf"))
    tf, size = F.col("tf"), F.col("len")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("average")))
    return sized.join(weight, "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int = 30) -> DataFrame:
    """The k best per query, ranked from 1; zero scores don't count and ties go by id.

    Sums come in any order, so scores tie that are equal to nine places.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("score", F.round("score", 9)).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
