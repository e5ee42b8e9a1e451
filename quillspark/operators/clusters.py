"""Exact nearest vectors by cluster bounds.

Vectors are laid out by their nearest of at most ``MOST_CLUSTERS`` centroids (fitted on about ``SAMPLE`` vectors), with the greatest distance from
the centroid in each cluster. For unit vectors cosine distance is half the squared distance between the ends, so the triangle
inequality gives, for a query and a cluster, the least and greatest distance that any member can have. The clusters that surely hold
the k nearest bound the k-th distance from above; clusters whose least distance is beyond it are neither read nor compared. The result is
that of ``vector.nearest``. How much this saves depends on the vectors: all of it where they lie in groups, nothing where they
are spread out evenly, which ``compared`` tells beforehand.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector
from .tables import materialize

MOST_CLUSTERS, SAMPLE, ROUNDS = 1_024, 20_000, 8
#: What computed distances may be off by.
SLACK = 1e-7


@dataclasses.dataclass(frozen=True)
class Clusters:
    """rows (cluster, id, embedding) by cluster, and each cluster's centroid, greatest distance from it and size."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def wanted(self, unit: np.ndarray, k: int) -> np.ndarray:
        """Which clusters (columns) may hold one of the k nearest of each query (rows)."""
        far = np.sqrt(np.maximum(0, (unit * unit).sum(axis=1)[:, None] + (self.centroids * self.centroids).sum(axis=1)[None, :] - 2 * unit @ self.centroids.T))
        least, most = np.maximum(0, far - self.radii - SLACK), far + self.radii + SLACK
        order = np.argsort(most, axis=1)
        enough = np.cumsum(self.sizes[order], axis=1) >= k
        place = np.where(enough.any(axis=1), enough.argmax(axis=1), most.shape[1] - 1)
        bound = np.where(enough.any(axis=1), np.take_along_axis(most, np.take_along_axis(order, place[:, None], 1), 1)[:, 0], np.inf)
        return (least <= bound[:, None]) & (self.sizes > 0)


def _fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids of a sample of unit vectors."""
    rng = np.random.default_rng(1)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def clustered(corpus: DataFrame, n_clusters: int | None = None) -> Clusters:
    """Lay out a corpus (id, embedding); null vectors are left out, vectors of length zero raise."""
    rows = corpus.select("id", "embedding").where("embedding is not null")
    n = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    every = max(1, n // SAMPLE)
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * SAMPLE).toPandas()  # about SAMPLE rows
    if not len(few):
        few = rows.limit(SAMPLE).toPandas()
    if not len(few):
        return Clusters(corpus.sparkSession.createDataFrame([], f"cluster int, id {kind}, embedding array<double>"), np.zeros((1, 1)), np.zeros(1), np.zeros(1, "i8"))
    centroids = _fitted(vector._units(list(few["embedding"])), n_clusters or min(MOST_CLUSTERS, max(1, int(n**0.5) // 2)))
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            unit = vector._units(list(batch["embedding"]))
            nearest = (unit @ own.T - (own * own).sum(axis=1) / 2).argmax(axis=1)
            yield pd.DataFrame({"cluster": nearest.astype("i4"), "gap": np.sqrt(((unit - own[nearest]) ** 2).sum(axis=1)), "id": batch["id"], "embedding": list(unit)})

    made = rows.mapInPandas(assign, f"cluster int, gap double, id {kind}, embedding array<double>")
    # By ranges, so that a large cluster is in several files.
    laid = materialize(made.repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id"), "clusters")
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), "i8")
    for r in laid.groupBy("cluster").agg(F.max("gap").alias("gap"), F.count("*").alias("n")).collect():  # a row a cluster
        radii[r.cluster], sizes[r.cluster] = r.gap, r.n
    return Clusters(laid.drop("gap"), centroids, radii, sizes)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the queries in blocks of bounded size."""
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 8 // vector.MOST_BYTES))
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        if len(some):
            yield some["query_id"].to_numpy(), vector._units(list(some["embedding"]))


def compared(queries: DataFrame, index: Clusters, k: int = 30) -> float:
    """The share of all pairs of query and vector that a search compares."""
    pairs = every = 0
    for _, unit in _blocks(queries) if index.sizes.sum() else ():
        pairs += int((index.wanted(unit, k) * index.sizes).sum())
        every += len(unit) * int(index.sizes.sum())
    return pairs / every if every else 0.0


def nearest(queries: DataFrame, index: Clusters, k: int = 30, digits: int = 12) -> DataFrame:
    """As vector.nearest: (query_id, id, distance, rank), from the clusters that may hold a result only."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, distance double"
    spark, out = queries.sparkSession, None
    for names, unit in _blocks(queries) if index.sizes.sum() else ():
        wanted = index.wanted(unit, k)
        shared = spark.sparkContext.broadcast((names, unit, wanted))
        rows = index.rows.where(F.col("cluster").isin(np.flatnonzero(wanted.any(axis=0)).tolist()))
        part = rows.mapInPandas(_kept(shared, k, digits), schema)
        out = part if out is None else out.unionByName(part)
    return vector.top(out if out is not None else spark.createDataFrame([], schema), k)


def _kept(shared, k: int, digits: int):
    """The task's part of ``nearest``: the k best of each query among the clusters that it wants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit, wanted = shared.value
        worst, kept, held = np.full(len(names), np.inf), [], 0

        def best() -> pd.DataFrame:
            rows = pd.concat(kept, ignore_index=True).sort_values(["q", "distance", "id"])
            rows = rows[rows.groupby("q").cumcount() < k]
            full = np.flatnonzero(np.bincount(rows["q"], minlength=len(names)) >= k)
            worst[full] = rows.groupby("q")["distance"].max().loc[full].to_numpy()
            return rows

        for batch in batches:
            for cluster, part in batch.groupby("cluster", sort=False):
                asking = np.flatnonzero(wanted[:, cluster])
                step = max(1, vector.CELLS // max(1, len(asking)))
                for some in (part.iloc[at : at + step] for at in range(0, len(part), step)):
                    gap = np.round(1 - unit[asking] @ np.stack(some["embedding"].to_numpy()).T, digits) + 0.0
                    q, j = np.nonzero(gap <= worst[asking][:, None])
                    kept.append(pd.DataFrame({"q": asking[q], "id": some["id"].to_numpy()[j], "distance": gap[q, j]}))
                    held += len(q)
                if held > vector.HELD:
                    kept = [best()]
                    held = len(kept[0])
        if held:
            rows = best()
            yield pd.DataFrame({"query_id": names[rows["q"].to_numpy()], "id": rows["id"].to_numpy(), "distance": rows["distance"].to_numpy()})

    return run
