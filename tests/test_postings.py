"""The block index: equal scores, fewer postings, indexes that outlive a call and a revision."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical, postings, retrieval, vector
from quillspark.operators.store import Store
from quillspark.streaming.ingest import default_embedding

ROWS = "id string, text string, source string, metadata string, embedding array<double>"


def corpus(spark, n=600, seed=4):
    rng = random.Random(seed)
    common, rare = [f"co{i}" for i in range(30)], [f"zx{i}q{i * 7 % 90}" for i in range(300)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(5, 60)) + rng.choices(rare, k=rng.randrange(0, 4))) for _ in range(n)]
    texts[5:9] = [None, "", "ＦＵＬＬ 犬 一人暮らし", "zx1q7 zx2q14 zx3q21 " * 3]
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3), texts


def asked(spark):
    return spark.createDataFrame([(1, "zx1q7 zx2q14 co1"), (2, "co3 co4 co5 co6"), (3, "full 犬 1人暮らし"), (4, ""), (5, None), (6, "nowhere ~"), (7, "zx9q63 " * 3)], "query_id int, text string")


def rows(found):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in found.collect())


@pytest.mark.parametrize("sizes", [(128, 2_000), (4, 50), (1, 7)])
def test_equal_to_scoring_everything(spark, monkeypatch, sizes):
    monkeypatch.setattr(postings, "BLOCK", sizes[0])
    monkeypatch.setattr(postings, "PART", sizes[1])
    docs, texts = corpus(spark)
    index = postings.blocks(docs).cache()
    for k in (1, 3, 30):
        assert rows(postings.top(asked(spark), index, k)) == rows(lexical.top(lexical.scores(asked(spark), lexical.index(docs)), k))
    live = docs.where("id % 3 = 0").select("id")
    part = docs.where("id % 3 = 0")
    assert rows(postings.top(asked(spark), index, 5, live)) == rows(lexical.top(lexical.scores(asked(spark), lexical.index(part)), 5))
    old = lexical.statistics(lexical.lengths(lexical.index(docs))).first()
    assert tuple(postings.statistics(index).first()) == tuple(old)
    frequency = {r.token: r.df for r in lexical.document_frequency(lexical.postings(lexical.index(docs)), lexical.statistics(lexical.lengths(lexical.index(docs)))).collect()}
    assert {r.token: r.df for r in postings.frequencies(index).collect()} == frequency
    assert postings.blocks(docs.limit(0)).count() == 0 and postings.top(asked(spark), postings.blocks(docs.limit(0))).count() == 0
    index.unpersist()


def test_fewer_postings_are_scored(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    docs, _ = corpus(spark, 2_000)
    index = postings.blocks(docs).cache()
    one = asked(spark).where("query_id = 1")
    planned = postings.plan(one, index, 3)
    kept = postings.kept_blocks(index, planned).agg(F.sum("n")).first()[0]
    every = index.join(planned.select("token"), "token", "left_semi").agg(F.sum("n")).first()[0]
    useless = {r.token for r in planned.where("not essential").collect()}
    assert "co" in useless and 0 < kept < every / 10
    index.unpersist()


def test_index_outlives_a_call_and_a_revision(spark, tmp_path, monkeypatch):
    """A second search on a revision indexes nothing; one after a new source indexes that source's texts only; results are those of a fresh index."""
    store = Store(spark, f"file://{tmp_path}/store")
    embedded = lambda data: spark.createDataFrame([(f"{s}::{i}", t, s, f'{{"location": {i}}}') for s, i, t in data], "id string, text string, source string, metadata string").withColumn("embedding", default_embedding(F.col("text")))
    store.add(embedded([("a", 1, "有給休暇の申請方法"), ("a", 2, "洗濯機の設置"), ("b", 1, "有給休暇の日数"), ("c", 1, "洗濯機の設置")]))
    queries = spark.createDataFrame([(1, "有給休暇の日数"), (2, "洗濯機")], "query_id int, text string").withColumn("embedding", default_embedding(F.col("text")))
    made, real = [], postings.blocks
    monkeypatch.setattr(postings, "blocks", lambda df, *a: made.append({r.text for r in df.collect()}) or real(df, *a))

    def search():
        hits = retrieval.search_store(queries, store, threshold=2.0).collect()
        return sorted((r.query_id, r.position, r.text, r.citation, r.n_places) for r in hits)

    first = search()
    assert first == search() and made == [{"有給休暇の申請方法", "洗濯機の設置", "有給休暇の日数"}]
    assert next(r for r in first if r[0] == 2)[2:] == ("洗濯機の設置", "a ほか1資料", 2)
    store.replace("d", embedded([("d", 1, "有給休暇の日数"), ("d", 2, "洗濯機の容量と有給休暇")]))
    second = search()
    assert made[1:] == [{"洗濯機の容量と有給休暇"}] and any("容量" in r[2] for r in second)
    store.delete_sources(spark.createDataFrame([("a",), ("d",)], "source string"))
    third = search()
    assert len(made) == 2 and {r[2] for r in third} == {"有給休暇の日数", "洗濯機の設置"}
    fresh = retrieval.search(queries, store.chunks(), threshold=2.0).collect()
    assert sorted((r.query_id, r.position, r.text) for r in fresh) == [r[:3] for r in third]
    store.compact()
    assert [r[:3] for r in search()] == [r[:3] for r in third]
    store.vacuum(1)
    assert [n for n in os.listdir(tmp_path / "store/lexical") if not n.startswith(".")] == [t["name"] for t in store.manifest()["texts"]]


def test_index_of_a_table_follows_its_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "abc")], "id int, text string").write.parquet(path)
    first = postings.of_table(spark, spark.read.parquet(path), "id").inputFiles()
    assert postings.of_table(spark, spark.read.parquet(path), "id").inputFiles() == first
    spark.createDataFrame([(2, "abd")], "id int, text string").write.mode("append").parquet(path)
    later = postings.of_table(spark, spark.read.parquet(path), "id")
    assert later.inputFiles() != first and {r.token: r.df for r in postings.frequencies(later).collect()} == {"ab": 2, "bc": 1, "bd": 1}


def test_failed_model_keeps_the_order(spark):
    chunks = spark.createDataFrame([(str(i), f"文章 {'あいうえおかきくけこ'[i]} です") for i in range(6)], "id string, text string").withColumn("embedding", default_embedding(F.col("text")))
    queries = spark.createDataFrame([(1, "文章"), (2, "文章")], "query_id int, text string").withColumn("embedding", default_embedding(F.col("text")))
    plain = [r.id for r in retrieval.search(queries, chunks, 2.0, 6).where("query_id = 1").orderBy("position").collect()]
    broken = retrieval.search(queries, chunks, 2.0, 6, lambda q, t: F.when(~t.contains("う"), F.lit(-5.0)), floor=1.0)
    assert [r.id for r in broken.where("query_id = 1").orderBy("position").collect()] == plain and not broken.first().measured
    assert retrieval.search(queries, chunks, 2.0, 6, lambda q, t: F.lit(-5.0), floor=1.0).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_nearest_per_value(spark, monkeypatch, small):
    if small:
        for name, value in {"MOST_BYTES": 200, "CELLS": 20, "HELD": 10}.items():
            monkeypatch.setattr(vector, name, value)
    rng = random.Random(2)
    data = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)], rng.choice([None, 1, 2, 3])) for i in range(90)]
    df = spark.createDataFrame([*data, (99, None, 1)], "id int, embedding array<double>, label int").repartition(3)
    queries = df.where("id % 9 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")
    every = vector.distances(queries, df.where("embedding is not null")).withColumn("distance", F.round("distance", 12) + F.lit(0.0)).join(df.select("id", "label"), "id").collect()
    best = {}
    for r in sorted(every, key=lambda r: (r.distance, r.id)):
        best.setdefault((r.query_id, r.label), []).append((r.id, r.distance))
    got = {}
    for r in vector.nearest(queries, df, 4, per="label").orderBy("rank").collect():
        got.setdefault((r.query_id, r.label), []).append((r.id, r.distance))
    assert got == {k: v[:4] for k, v in best.items()}
    whole = {}
    for r in sorted(every, key=lambda r: (r.distance, r.id)):
        whole.setdefault(r.query_id, []).append(r.id)
    got = {}
    for r in vector.nearest(queries, df, 7).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {k: v[:7] for k, v in whole.items()}
