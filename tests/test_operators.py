import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog, chunking, evaluation, lexical, navigation, retrieval, vector
from quillspark.operators.catalog import Ranking
from quillspark.operators.predicate import WhereError, column_value, compile_where, variant_value


def ids(df, column="id"):
    return [r[0] for r in df.select(column).collect()]


def test_bm25_properties(spark):
    corpus = spark.createDataFrame([("a", "ファインチューニング"), ("b", "有給休暇"), ("c", "洗濯容量"), ("d", "")], "id string, text string")
    tokens = lexical.tokens(corpus)
    search = lambda q: lexical.top(lexical.scores(spark.createDataFrame([(1, q)], "query_id int, text string"), tokens))
    assert ids(search("洗濯")) == ["c"]
    assert ids(search("天気")) == []
    same = spark.createDataFrame([(x, "有給休暇") for x in "cab"], "id string, text string")
    hits = lexical.top(lexical.scores(spark.createDataFrame([(1, "有給")], "query_id int, text string"), lexical.tokens(same)))
    assert [r.id for r in hits.orderBy("rank").collect()] == ["a", "b", "c"]
    stats = lexical.statistics(lexical.lengths(tokens)).first()
    assert stats.n == 4 and lexical.statistics(lexical.lengths(tokens.limit(0))).first().average == 1.0


def test_bm25_against_plain_python(spark):
    import math
    from collections import Counter

    texts = {0: "abc abd", 1: "abc", 2: "xyz abc abc", 3: "q"}
    grams = lambda t: [w[i : i + 2] for w in t.split() for i in range(len(w) - 1)] or t.split()
    docs = {k: Counter(grams(v)) for k, v in texts.items()}
    avg = sum(sum(d.values()) for d in docs.values()) / len(docs)
    want = {}
    for token in grams("abc abc"):
        df = sum(token in d for d in docs.values())
        for k, d in docs.items():
            if d[token]:
                w = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                want[k] = want.get(k, 0) + w * d[token] * 2.2 / (d[token] + 1.2 * (0.25 + 0.75 * sum(d.values()) / avg))
    corpus = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = lexical.scores(spark.createDataFrame([(1, "abc abc")], "query_id int, text string"), lexical.tokens(corpus)).collect()
    assert {r.id: round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_cosine_ties_and_zero(spark):
    rows = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 3.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [5.0, 0.0])], "query_id int, embedding array<double>")
    top = vector.top(vector.distances(asked, rows), 2).orderBy("rank").collect()
    assert [(r.id, round(r.distance, 9)) for r in top] == [("a", 0.0), ("b", 0.0)]
    with pytest.raises(Exception, match="length zero"):
        vector.distances(spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, embedding array<double>"), rows).collect()


def _hits(spark, near, lex):
    n = spark.createDataFrame([(1, i, d, r) for r, (i, d) in enumerate(near, 1)], "query_id int, id string, distance double, rank int")
    b = spark.createDataFrame([(1, i, s, r) for r, (i, s) in enumerate(lex, 1)], "query_id int, id string, score double, rank int")
    return retrieval.fuse(n, b).orderBy("position").collect()


def test_fusion(spark):
    assert _hits(spark, [("a", 0.60), ("b", 0.62)], [("a", 5.0)]) == []  # closed gate
    rescued = _hits(spark, [("b", 0.10), ("a", 0.60)], [("a", 5.0)])
    assert {(r.id, r.distance, r.bm25) for r in rescued} == {("a", 0.60, 5.0), ("b", 0.10, None)}
    assert _hits(spark, [("b", 0.20), ("a", 0.30)], [("a", 1.0)])[0].id == "a"
    backfilled = _hits(spark, [("a", 0.5)], [("z", 1.0)])
    assert [(r.id, r.distance) for r in backfilled] == [("a", 0.5), ("z", None)]


def test_rerank_and_floor(spark):
    hits = spark.createDataFrame([(1, str(i), i, s) for i, s in enumerate([5.0, 0.5, 2.0], 1)], "query_id int, id string, position int, s double")
    assert ids(retrieval.rerank(hits, F.col("s"), floor=1.0).orderBy("position")) == ["1", "3"]
    assert ids(retrieval.rerank(hits, F.col("s"), floor=9.0)) == []
    assert ids(retrieval.rerank(hits, F.col("s"), floor=1.0, measured=F.lit(False)).orderBy("position")) == ["1", "2", "3"]
    assert ids(retrieval.rerank(hits, F.col("s"), head=2).orderBy("position")) == ["1", "2", "3"]


def test_near_duplicates(spark):
    body = "x" * 50 + "日本語の本文です。" * 20
    rows = [(1, 1, "a", body), (1, 2, "b", body + "。"), (1, 3, "c", "まったく別の文章"), (1, 4, "d", "もうひとつ")]
    hits = spark.createDataFrame(rows, "query_id int, position int, id string, text string")
    assert ids(retrieval.without_near_duplicates(hits, 2).orderBy("position")) == ["a", "c"]


def test_search_end_to_end(spark):
    from quillspark.streaming.ingest import default_embedding

    chunks = spark.createDataFrame([("a", "有給休暇の申請方法"), ("b", "洗濯機の設置"), ("c", "有給休暇の日数")], "id string, text string").withColumn("embedding", default_embedding(F.col("text")))
    asked = spark.createDataFrame([(1, "有給休暇の日数")], "query_id int, text string").withColumn("embedding", default_embedding(F.col("text")))
    found = retrieval.search(asked, chunks).orderBy("position").collect()
    assert found[0].id == "c"


PRODUCTS = [("UD-1100iS", 26, 510, None), ("UD-1100i", 26, 540, None), ("UD-1100iE", 26, 540, None), ("UD-1000S", 28, 510, None)]


def test_catalog(spark):
    products = spark.createDataFrame([(m + ".md", m, n, d) for m, n, d, _ in PRODUCTS], "source string, model_id string, noise_wash_db int, depth int")
    both = {"noise_wash_db": {"$lte": 26}, "depth": {"$lte": 510}}
    assert ids(catalog.select(products, both), "model_id") == ["UD-1100iS"]
    assert ids(catalog.select(products, {}), "model_id") == []
    relaxed = {(r.dropped, r.model_id) for r in catalog.relaxations(products, both).collect()}
    assert relaxed == {("depth", "UD-1100i"), ("depth", "UD-1100iE"), ("noise_wash_db", "UD-1000S")}
    assert catalog.relaxations(products, {"depth": {"$lte": 510}}).count() == 0
    lines = catalog.table_lines(products, both, Ranking("noise_wash_db", False)).orderBy("section", "line_no").collect()
    assert lines[0].line.endswith("全条件に合致（1件）") and lines[1].line == "UD-1100iS | noise_wash_db=26 | depth=510"


def test_exceeding(spark):
    rows = [("a", 10.0, 510), ("b", 11.0, 510), ("c", 14.0, 545), ("d", 5.0, 545), ("e", None, None)]
    products = spark.createDataFrame(rows, "source string, capacity double, depth int")
    where = {"depth": {"$lte": 510}}
    assert ids(catalog.exceeding(products, where, Ranking("capacity", True)), "source") == ["c"]
    assert ids(catalog.exceeding(products, where, Ranking("capacity", False)), "source") == ["d"]
    assert ids(catalog.exceeding(products, {"depth": {"$lte": 1}}, Ranking("capacity", True)), "source") == []
    assert ids(catalog.select(products, where).orderBy(*catalog.rank_order(products, Ranking("capacity", True))), "source") == ["b", "a"]


def test_fold_and_schema(spark):
    chunks = spark.createDataFrame([("a", 2, 9), ("a", 1, 7), ("", 3, 1), (None, 4, 1)], "source string, o int, n int")
    assert [tuple(r) for r in catalog.fold(chunks, ["n"], "o").collect()] == [("a", 7)]
    meta = spark.createDataFrame([(1, '{"k": true, "s": "x", "source": "y"}'), (2, '{"k": 3, "s": 4}')], "o int, j string")
    assert {tuple(r) for r in catalog.available_keys(meta, "j", "o").collect()} == {("k", "number"), ("s", "string")}


def test_condition_replies():
    schema = {"noise": "number", "tier": "string"}
    assert catalog.valid_conditions({"noise": {"lte": 26}, "x": {"$lte": 1}, "tier": {"$eq": " "}}, schema) == {"noise": {"$lte": 26}}
    assert catalog.valid_conditions({"noise": {"$lte": True, "$gte": 3}}, schema) == {"noise": {"$gte": 3}}
    assert catalog.valid_conditions({"tier": {"$eq": "high"}}, schema) == {"tier": {"$eq": "high"}}


def test_grounding(spark):
    rows = [("奥行き５１０mm以下", "510", True), ("510mm", "10", True), ("高級な機種", "高級", False)]
    df = spark.createDataFrame(rows, "question string, value string, is_number boolean")
    df = df.withColumn("question", F.translate("question", "０１２３４５６７８９", "0123456789"))
    assert [r[0] for r in df.select(catalog.grounded(df)).collect()] == [True, False, True]


def test_predicates(spark):
    df = spark.createDataFrame([(1, '{"n": 26, "s": "x"}'), (2, '{"n": "26"}'), (3, "{}"), (4, '{"n": true}')], "id int, j string").withColumn("a", F.parse_json("j"))
    match = lambda w: ids(df.where(compile_where(w, variant_value("a"))).orderBy("id"))
    assert match({}) == match(None) == [1, 2, 3, 4]
    assert match({"n": 26}) == [1]
    assert match({"n": {"$lte": 30}}) == [1, 4]
    assert match({"n": {"$lte": "30"}}) == [2]
    assert match({"missing": None}) == [1, 2, 3, 4]
    assert match({"$and": [{"n": {"$gte": 20, "$lte": 26}}, {"s": "x"}]}) == [1]
    assert match({"n": 1}) == [4]
    for bad in ({"n": {"$ne": 1}}, {"$or": []}):
        with pytest.raises(WhereError):
            compile_where(bad, column_value({}))


@pytest.mark.parametrize(
    ("text", "nav"),
    [
        ("3\n転移学習とファインチューニング", True), ("－ 目次 ー\n1 はじめに", True), ("ご清聴ありがとうございました\nAIとともに", True),
        ("１" + "\n" * 18 + "表紙", False), ("17\n18\n19", False), ("本文です", False), ("", False), ("ご清聴" + "x" * 60, False), ("①\n章", True),
    ],
)
def test_navigation(spark, text, nav):
    assert spark.createDataFrame([(text,)], "t string").select(navigation.is_navigation(F.col("t"))).first()[0] is nav


def test_source_of_navigation_alone_stays(spark):
    rows = [("a", "1\n章"), ("a", "本文"), ("b", "1\n章"), ("b", "2\n章")]
    flagged = navigation.marked(spark.createDataFrame(rows, "source string, text string"))
    assert sorted((r.source, r.dropped) for r in flagged.collect()) == [("a", False), ("a", True), ("b", False), ("b", False)]


def test_splitting():
    assert chunking.split_text("a" * 800) == ["a" * 800]
    assert chunking.split_text("a" * 9) == [] and chunking.split_text("a" * 10) == ["a" * 10]
    text = "。".join("文" * 30 for _ in range(60))
    parts = chunking.split_text(text)
    assert len(parts) > 1 and all(10 <= len(p) <= 800 for p in parts)
    assert set("".join(parts)) == {"文", "。"} and len("".join(parts)) >= len(text) - 2
    assert len(chunking.split_text("x" * 801)) == 2 or len(chunking.split_text("x" * 801)) == 1
    code = "説明文です。" * 100 + "\n\n```\n" + "y = 1\n" * 150 + "```\n終わりの文章です。"
    assert any(p.count("```") == 2 for p in chunking.split_keeping_code(code))
    listed = "- item\n\n    continued one\n    continued two\n"
    assert chunking.code_spans(listed) == []
    assert len(chunking.code_spans("text\n\n    a = 1\n    b = 2\n\nmore")) == 1


def test_chunk_ids(spark):
    rows = [("a.pdf", "page", 1, 0, "x" * 20), ("a.pdf", "page", 1, 1, "y" * 20), ("a.pdf", "page", 2, 2, "z" * 20)]
    found = chunking.chunk(spark.createDataFrame(rows, "source string, location_type string, location int, unit_seq int, text string"))
    assert sorted(ids(found)) == ["a.pdf::page1::0", "a.pdf::page1::1", "a.pdf::page2::0"]


def test_evaluation(spark):
    measured = spark.createDataFrame([("relevant", 0.2, 3.0), ("relevant", 0.4, 2.0), ("out_of_domain", 0.6, 9.0)], "kind string, distance double, bm25 double")
    r = evaluation.separation(measured, 0.5).first()
    assert (r.max_relevant, r.min_out_of_domain, r.max_out_bm25, r.min_relevant_bm25, r.separated) == (0.4, 0.6, 9.0, 2.0, True)
    results = spark.createDataFrame([("relevant", 0, None), ("relevant", 2, False), ("out_of_domain", 1, None)], "kind string, n_hits int, expected_found boolean")
    assert tuple(evaluation.verdict(results).first()) == (1, 1, 1, False)
    samples = spark.createDataFrame([(float(i), "x") for i in range(1, 11)], "s double, g string")
    assert evaluation.latency(samples, "s", ["g"]).select("p50", "p90", "median").first() == (5.0, 9.0, 5.5)
