"""Revisions of the store: segments by source, refused commits, bounded folders, migration."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import store as stores
from quillspark.operators.store import Store, StoreConflict, StoreError

ROWS = "id string, text string, source string, metadata string, embedding array<double>"


def rows(spark, *data):
    return spark.createDataFrame([(i, t, s, "{}", [1.0, float(len(t))]) for i, t, s in data], ROWS)


def held(store):
    chunks = {r.id: r.text for r in store.chunks().collect()}
    return {r.id: (r.source, chunks[r.chunk_id]) for r in store.occurrences().collect()}


def folders(tmp_path, kind):
    return {n for n in os.listdir(tmp_path / "store") if n.startswith(kind + "-")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_one_source_writes_one_segment(spark, store, tmp_path):
    store.add(rows(spark, *[(f"s{i}::1", f"text {i % 300}", f"s{i}") for i in range(1_000)]))
    before = {k: folders(tmp_path, k) for k in ("segment", "texts", "vectors")}
    assert store.replace("s7", rows(spark, ("s7::1", "quite new", "s7"), ("s7::2", "text 8", "s7"))) == 2
    new = {k: folders(tmp_path, k) - v for k, v in before.items()}
    assert {k: len(v) for k, v in new.items()} == {"segment": 1, "texts": 1, "vectors": 1}
    written = spark.read.parquet(f"file://{tmp_path}/store/{new['segment'].pop()}")
    assert sorted(r.id for r in written.collect()) == ["s7::1", "s7::2"]
    assert [r.text for r in spark.read.parquet(f"file://{tmp_path}/store/{new['texts'].pop()}").collect()] == ["quite new"]
    now = held(store)
    assert len(now) == 1_001 and now["s7::2"] == ("s7", "text 8") and now["s307::1"] == ("s307", "text 7") and store.texts().count() == 301


def test_second_writer_is_refused(spark, store, tmp_path):
    store.add(rows(spark, ("a::1", "one", "a")))
    base = store.manifest()
    assert store.replace_many(rows(spark, ("b::1", "two", "b")), on=base) == 2
    before = set(os.listdir(tmp_path / "store")), held(store)
    with pytest.raises(StoreConflict):
        store.replace_many(rows(spark, ("c::1", "three", "c")), on=base)
    assert (set(os.listdir(tmp_path / "store")), held(store)) == before and store.revision == 2
    assert held(store) == {"a::1": ("a", "one"), "b::1": ("b", "two")}


def test_add_moves_and_overwrites(spark, store):
    store.add(rows(spark, ("x", "one", "a"), ("y", "two", "a"), ("z", "one", "b")))
    store.add(rows(spark, ("x", "three", "b")))
    assert held(store) == {"x": ("b", "three"), "y": ("a", "two"), "z": ("b", "one")}
    assert sorted(r.text for r in store.chunks().collect()) == ["one", "three", "two"]
    store.delete({"source": "b"})
    assert held(store) == {"y": ("a", "two")} and [r.text for r in store.chunks().collect()] == ["two"]


def test_later_vectors_count(spark, store):
    store.add(rows(spark, ("x", "one", "a"), ("y", "two", "a")))
    changed = rows(spark, ("x", "one", "a"), ("y", "two", "a")).withColumn("embedding", F.when(F.col("id") == "x", F.array(F.lit(0.0), F.lit(2.0))).otherwise(F.col("embedding")))
    store.replace("a", changed)
    assert store.manifest()["versions"] and len(store.manifest()["texts"]) == 1
    found = {r.text: r.embedding for r in store.chunks().collect()}
    assert found["one"] == [0.0, 1.0] and found["two"] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])
    store.compact()
    assert {r.text: r.embedding for r in store.chunks().collect()} == found and not store.manifest()["versions"]


def test_folders_stay_few(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_FOLDERS", 4)
    for i in range(9):
        store.replace(f"s{i % 7}", rows(spark, (f"s{i % 7}::1", f"text {i}", f"s{i % 7}"), (f"s{i % 7}::2", "same", f"s{i % 7}")))
        now = store.manifest()
        assert all(len(now[k]) <= 4 for k in ("segments", "texts", "vectors"))
    want = {f"s{i % 7}::1": (f"s{i % 7}", f"text {i}") for i in range(9)} | {f"s{i}::2": (f"s{i}", "same") for i in range(7)}
    assert held(store) == want and store.chunks().count() == 8
    store.compact()
    now = store.manifest()
    assert [len(now[k]) for k in ("segments", "texts", "vectors")] == [1, 1, 1] and not now["garbage"] and held(store) == want
    assert sum(t["rows"] for t in now["texts"]) == 8
    store.vacuum(1)
    assert {k: len(folders(tmp_path, k)) for k in ("segment", "texts", "vectors", "sources")} == dict.fromkeys(("segment", "texts", "vectors", "sources"), 1)
    assert held(store) == want and [n for n in os.listdir(tmp_path / "store/manifests") if n.endswith(".json")] == [f"{now['revision']:012d}.json"]


def old_store(spark, tmp_path, revision=7):
    chunks, occurrences = Store.prepared(rows(spark, ("a::1", "one", "a"), ("a::2", "two", "a"), ("b::1", "one", "b")))
    root = tmp_path / "store"
    chunks.write.parquet(f"file://{root}/rev-x/chunks")
    occurrences.write.parquet(f"file://{root}/rev-x/occurrences")
    (root / "manifest.json").write_text(json.dumps({"revision": revision, "folder": "rev-x"}))
    return root


def test_old_store_is_refused_then_migrated(spark, store, tmp_path):
    root = old_store(spark, tmp_path)
    for read in (lambda: store.chunks(), lambda: store.add(rows(spark, ("c", "d", "e")))):
        with pytest.raises(StoreError, match="migrate_store"):
            read()
    assert stores.migrate_store(spark, store.path) == 7
    assert held(store) == {"a::1": ("a", "one"), "a::2": ("a", "two"), "b::1": ("b", "one")} and store.revision == 7
    assert (root / "manifest.v1.json").exists() and (root / "rev-x/chunks").exists()
    assert store.add(rows(spark, ("c::1", "new", "c"))) == 8
    with pytest.raises(StoreError):
        stores.migrate_store(spark, store.path)


def test_failed_verification_leaves_the_old_store(spark, store, tmp_path, monkeypatch):
    root = old_store(spark, tmp_path)
    before = sorted(os.listdir(root))
    calls = []
    monkeypatch.setattr(stores, "content", lambda df, columns: calls.append(columns) or len(calls))
    with pytest.raises(StoreError, match="verification"):
        stores.migrate_store(spark, store.path)
    assert [n for n in sorted(os.listdir(root)) if n != "manifests"] == before
    monkeypatch.undo()
    (root / "manifest.json").write_text(json.dumps({"revision": 7, "folder": "rev-x"}))
    assert stores.migrate_store(spark, store.path) == 7


def test_orphans_and_one_table(spark, store, tmp_path):
    single = rows(spark, ("a::1", "one", "a"), ("b::1", "one", "b"))
    assert stores.migrate_store(spark, store.path, single, revision=3) == 3
    assert store.texts().count() == 1 and store.occurrences().count() == 2
    future = json.loads((tmp_path / "store/manifests/000000000003.json").read_text()) | {"schema": 9}
    (tmp_path / "store/manifests/000000000004.json").write_text(json.dumps(future))
    with pytest.raises(StoreError, match="schema 9"):
        store.chunks()
