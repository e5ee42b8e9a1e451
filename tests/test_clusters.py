"""Nearest vectors by cluster bounds: the same rows as by comparing all, from fewer comparisons where vectors lie in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import clusters, vector

ROWS = "id int, embedding array<double>"


def table(spark, grouped):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    data = [centers[i % 12] + 0.05 * rng.normal(size=16) if grouped else rng.normal(size=16) for i in range(900)]
    data[40] = data[41] = data[0]  # ties
    return spark.createDataFrame([*((i, (x * (1 + i % 3)).tolist()) for i, x in enumerate(data)), (2_000, None)], ROWS).repartition(3)


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("k", [1, 5, 1_000])
def test_same_rows(spark, monkeypatch, grouped, k):
    monkeypatch.setattr(vector, "HELD", 500)
    rows = table(spark, grouped)
    queries = rows.where("id % 45 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")
    index = clusters.clustered(rows, 30)
    want, got = ({(r.query_id, r["rank"]): (r.id, r.distance) for r in f.collect()} for f in (vector.nearest(queries, rows, k, 9), clusters.nearest(queries, index, k, 9)))
    assert got == want and len(got) == 20 * min(k, 900)
    share = clusters.compared(queries, index, k)
    assert share == 1.0 if k == 1_000 else share < 0.25 if grouped else share <= 1.0
    assert int(index.sizes.sum()) == 900


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    queries = table(spark, True).where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    index = clusters.clustered(none)
    assert index.sizes.sum() == 0 and clusters.nearest(none.withColumnRenamed("id", "query_id"), clusters.clustered(table(spark, True), 5)).count() == 0
    assert clusters.compared(queries, index) == 0.0 and clusters.nearest(queries, index).count() == 0
