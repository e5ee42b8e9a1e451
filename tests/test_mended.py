"""Texts that nothing gets lost of, typed metadata, full-width text, and files that change."""

import difflib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import catalog, chunking, lexical, retrieval, vector
from quillspark.operators.predicate import compile_where, variant_value
from quillspark.operators.store import Store, StoreError
from quillspark.operators.tables import numbered
from quillspark.plans import registry
from quillspark.streaming import ingest

TABLES = "/root/testdata/sf0.001"


def lines_of(draw_words):
    return st.lists(st.one_of(st.just(""), st.just("```"), draw_words, draw_words.map(lambda x: "    " + x), st.integers(200, 3000).map(lambda n: "long " * (n // 5))), max_size=25).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(lines_of(st.text("abc .:", min_size=1, max_size=30)))
def test_no_word_is_lost(body):
    parts = chunking.split_keeping_code(body)
    if parts:
        assert set(body.split()) <= {w for p in parts for w in p.split()} or any(len(w) > 800 for w in body.split())
    else:
        assert len(body.strip()) < 2 * chunking.LEAST + 10


def test_short_prose_stays_with_its_block():
    block = "```\n" + "code line\n" * 300 + "```"
    assert any("After:" in p for p in chunking.split_keeping_code(f"{'Some words here. ' * 5}\n\nAfter:\n{block}"))
    prose = "a" * 395 + "\n\n" + "b" * 399
    parts = chunking.split_keeping_code(f"{prose}\n\nAnd:\n```\ncode of ten letters\n```\nend")
    assert any("And:" in p and "```" in p for p in parts) and any("end" in p for p in parts)


@pytest.mark.parametrize("name", ["chunk_code_documents", "chunk_documents"])
def test_chunks_of_a_table_equal_plain_python(spark, name):
    split = chunking.split_keeping_code if name == "chunk_code_documents" else chunking.split_text
    want = {(f"doc/{r.doc_id}", i, p) for r in registry.table(spark, TABLES, "documents").collect() for i, p in enumerate(split(r.text or ""))}
    got = registry.queries()[name](spark, TABLES).collect()
    assert {(r.source, r.chunk_index, r.text) for r in got} == want and len(got) == len(want)


def test_full_width_text_is_found(spark):
    corpus = spark.createDataFrame([(1, "ＲＡＧ の Ⅳ ﾃｽﾄ"), (2, "other words"), (3, None), (4, "")], "id int, text string")
    asked = spark.createDataFrame([(1, "rag"), (2, "ｗｏｒｄｓ"), (3, "テスト iv")], "query_id int, text string")
    for indexed in (lexical.index(corpus), lexical.tokens(corpus)):
        assert {(r.query_id, r.id) for r in lexical.top(lexical.scores(asked, indexed)).collect()} == {(1, 1), (2, 2), (3, 1)}
    rows = spark.createDataFrame([("容量は１６GB", "16", True), ("型番はＡＢ", "AB", False)], "question string, value string, is_number boolean")
    assert [r.g for r in rows.select(catalog.grounded(rows).alias("g")).collect()] == [True, True]


def test_stable_characters():
    import re
    import unicodedata

    stable = re.compile(f"[{text.STABLE}]")
    bad = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c)) and not unicodedata.is_normalized("NFKC", "a" + chr(c))]
    assert not bad


def test_index_counts_what_the_expression_gives(spark):
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab c_1,２Ａ十三ÄßΣσİé犬 \n") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "x", "x y", "  "]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, text string")
    want = {(r.token, r.id): r.tf for r in lexical.postings(lexical.tokens(df)).collect()}
    assert {(r.token, r.id): r.tf for r in lexical.postings(lexical.index(df)).collect()} == want
    lens = {r.id: r.len for r in lexical.lengths(lexical.tokens(df)).collect()}
    assert {r.id: r.len for r in lexical.lengths(lexical.index(df)).collect()} == lens


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[200:] = x[:100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>").repartition(5)
    asked = rows.where("id < 10").withColumnRenamed("id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    gap = np.round(1 - unit[:10] @ unit.T, 12) + 0.0
    want = {(q, int(i), r + 1) for q in range(10) for r, i in enumerate(np.lexsort((np.arange(300), gap[q]))[:7])}
    assert {(r.query_id, r.id, r["rank"]) for r in vector.nearest(asked, rows, 7).collect()} == want
    assert vector.nearest(asked.limit(0), rows).count() == 0
    assert vector.distances(asked, rows).count() == 3000


def test_alike_is_the_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice("abx")
        b = "".join(b)
        assert retrieval.alike(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() >= retrieval.SAME_RATIO)


def test_suppression_equals_plain_python(spark):
    """The registered query against a walk over its hits."""
    from quillspark.plans import search_queries

    hits = search_queries._reranked(spark, TABLES, None).select("query_id", "position", "id", "text").collect()
    want = set()
    for q in {r.query_id for r in hits}:
        kept = []
        for r in sorted((r for r in hits if r.query_id == q), key=lambda r: r.position):
            body = " ".join((r.text or "").split())
            if len(kept) < 4 and all(difflib.SequenceMatcher(None, body, k).ratio() < 0.98 for k in kept):
                kept.append(body)
                want.add((q, r.position, r.id))
    assert {tuple(r) for r in registry.queries()["near_duplicate_suppression"](spark, TABLES).collect()} == want


def test_numbering_is_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    assert all(r.number == r.v + 1 for r in numbered(df, [F.col("v")]).collect())


def write(folder, name, body):
    with open(os.path.join(folder, name), "w") as f:
        f.write(body)


def test_attributes_keep_their_types_and_changed_files_are_seen(spark, tmp_path):
    root, store, state = tmp_path / "in", Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "state")
    root.mkdir()
    write(root, "a.md", "---\nsize: 5\nname: box\n---\n# Title\nThe first text is long enough to be kept.")
    write(root, "b.txt", "The second text is long enough as well.")
    ingest.watch_folder(spark, str(root), store, state)
    rows = store.occurrences().withColumn("m", F.try_parse_json("metadata"))
    assert rows.where(compile_where({"size": {"$gte": 3}}, variant_value("m"))).count() == 1
    kinds = {r.key: r.kind for r in catalog.available_keys(rows, "metadata", "id").collect()}
    assert kinds["size"] == "number" and kinds["name"] == "string"
    revision = store.revision
    ingest.watch_folder(spark, str(root), store, state)
    assert store.revision == revision
    write(root, "b.txt", "The second text has changed and is still long enough.")
    os.utime(root / "b.txt", (2_000_000_000, 2_000_000_000))
    ingest.watch_folder(spark, str(root), store, state)
    assert store.revision == revision + 1 and store.chunks().where("text like '%changed%'").count() == 1 and store.chunks().count() == 2
    with open(root / "a.md", "wb") as f:
        f.write(b"\xff\xfe\xff\xff\x81")
    ingest.watch_folder(spark, str(root), store, state)
    assert store.occurrences().where("source = 'a.md'").count() == 1
    assert store.delete({"size": {"$gte": 99}}) == store.revision
    store.delete({"size": {"$gte": 3}})
    assert store.occurrences().where("source = 'a.md'").count() == 0
    with pytest.raises(StoreError):
        store.delete({})


def test_the_last_of_equal_ids_counts(spark):
    rows = spark.createDataFrame([("x", "b text", "s", "{}", [1.0], 2), ("x", "a text", "s", "{}", [1.0], 3)], "id string, text string, source string, metadata string, embedding array<double>, seq int")
    assert [r.text for r in Store.prepared(rows)[0].collect()] == ["a text"]
    assert [r.text for r in Store.prepared(rows.drop("seq"))[0].collect()] == ["b text"]
