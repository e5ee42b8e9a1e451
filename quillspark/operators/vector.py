"""Exact cosine search over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted_bigrams

#: Query vectors that ``distances`` broadcasts at once, and bytes of them that ``nearest`` does.
MOST_QUERIES, MOST_BYTES = 2_000, 32_000_000
#: Distances that a task holds at once, and pairs after which it keeps the best only.
CELLS, HELD = 4_000_000, 400_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector raises."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.raise_error(F.lit("a vector of length zero has no direction")).cast("array<double>"))


def distances(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, distance) of every query against every vector of the corpus.

    For callers that need every distance; ``nearest`` keeps a few per query within the tasks. A stated set of queries, in blocks of at most
    MOST_QUERIES that are broadcast one after the other; the corpus isn't shuffled. Inputs are (query_id, embedding) and (id, embedding).
    """
    unit = queries.select("query_id", normalised(F.col("embedding")).alias("q"))
    rows = corpus.select("id", normalised(F.col("embedding")).alias("v"))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    out = None
    for i in range(blocks):
        some = unit.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else unit
        part = rows.crossJoin(F.broadcast(some)).select("query_id", "id", (1 - dot(F.col("q"), F.col("v"))).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


def _units(rows: list[np.ndarray]) -> np.ndarray:
    raw = np.array(rows, "f8")
    size = np.sqrt((raw * raw).sum(axis=1))
    if not size.all():
        raise ValueError("a vector of length zero has no direction")
    return raw / size[:, None]


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 30, digits: int = 12, per: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of the corpus for each query, ties in the rounded distance by id; with ``per``, a
    column of the corpus, the k nearest of each of its values, and the column.

    Every vector is compared with every query, by matrix products in the tasks, and a task keeps the k best, so what is shuffled is at
    most k rows per query (and value) and task. Queries go to the tasks in blocks of at most MOST_BYTES. Null vectors are left out.
    """
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": corpus.schema["id"].dataType.simpleString()}
    named = [per] if per else []
    schema = ", ".join([f"query_id {kinds['query_id']}, id {kinds['id']}, distance double", *[f"`{c}` {corpus.schema[c].dataType.simpleString()}" for c in named]])
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks, out, context = max(1, -(-n * width * 8 // MOST_BYTES)), None, corpus.sparkSession.sparkContext
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()  # of about MOST_BYTES
        if len(some):
            shared = context.broadcast((some["query_id"].to_numpy(), _units(list(some["embedding"]))))
            part = corpus.select("id", "embedding", *named).where("embedding is not null").mapInPandas(_kept(shared, k, digits, per), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], schema)
    return top(out, k, per)


def _kept(shared, k: int, digits: int, per: str | None):
    """The task's part of ``nearest``: the k best of each query so far, and of each value of ``per``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        worst: dict = {}  # value of per -> each query's k-th distance so far
        kept: list[pd.DataFrame] = []

        def best() -> pd.DataFrame:
            rows = pd.concat(kept, ignore_index=True).sort_values(["q", "distance", "id"])
            rows = rows[rows.groupby(["q", "value"], dropna=False).cumcount() < k]
            for value, part in rows.groupby("value", dropna=False):
                counts, last = np.bincount(part["q"], minlength=len(names)), part.groupby("q")["distance"].max()
                full = np.flatnonzero(counts >= k)
                worst[_key(value)][full] = last.loc[full].to_numpy()
            return rows

        step, held = max(1, CELLS // len(names)), 0
        for batch in (b.iloc[at : at + step] for b in batches for at in range(0, len(b), step)):
            ids, values = batch["id"].to_numpy(), batch[per].to_numpy() if per else np.zeros(len(batch), "i8")
            gap = np.round(1 - unit @ _units(list(batch["embedding"])).T, digits) + 0.0
            for code, value in enumerate(uniques := pd.factorize(values, use_na_sentinel=False)[1]):
                mine = np.flatnonzero(pd.factorize(values, use_na_sentinel=False)[0] == code) if len(uniques) > 1 else np.arange(len(batch))
                limit = worst.setdefault(_key(value), np.full(len(names), np.inf))
                q, j = np.nonzero(gap[:, mine] <= limit[:, None])
                kept.append(pd.DataFrame({"q": q, "value": np.repeat(np.asarray([value]), len(q)), "id": ids[mine[j]], "distance": gap[q, mine[j]]}))
                held += len(q)
            if held > HELD:
                kept = [best()]
                held = len(kept[0])
        if held:
            rows = best()
            out = pd.DataFrame({"query_id": names[rows["q"].to_numpy()], "id": rows["id"].to_numpy(), "distance": rows["distance"].to_numpy()})
            yield out.assign(**{per: rows["value"].to_numpy()}) if per else out

    return run


def _key(value):
    """A dictionary key of a value that may be missing."""
    return None if pd.isna(value) else value


def top(distanced: DataFrame, k: int = 30, per: str | None = None) -> DataFrame:
    """The k nearest per query (and value of ``per``), ranked from 1, ties by id."""
    order = Window.partitionBy("query_id", *([per] if per else [])).orderBy("distance", "id")
    return distanced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of a text's hashed bigrams."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        starts, codes, counts = counted_bigrams([x or "" for x in s])
        hashed = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        signed = counts * np.where(hashed & np.uint64(1 << 40), 1.0, -1.0)
        cells = (hashed % np.uint64(dim)).astype("i8")
        return pd.Series([np.bincount(cells[a:b], signed[a:b], minlength=dim) for a, b in zip(starts, starts[1:], strict=False)], index=s.index, dtype=object)

    return run(text)
