"""Lexical, vector and hybrid search over documents, embeddings and benchmark passages.

The queries of a search are the rows whose id is divisible by 50; they meet all rows of the searched table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import bigrams
from ..operators import clusters, evaluation, lexical, postings, retrieval, vector
from ..operators.tables import materialize
from .registry import query, table

#: Bigram tokens of a text in DuckDB SQL.
TOKENS = r"""flatten(list_transform(list_filter(regexp_split_to_array(translate(lower(coalesce({0}, '')), '〇零一二三四五六七八九', '00123456789'), '[^\p{{L}}\p{{N}}_]+'), lambda s: s <> ''),
  lambda s: CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END))"""
_DOC = TOKENS.format("text")

_BM25 = f"""
t AS (SELECT doc_id AS id, {_DOC} AS ts FROM documents),
st AS (SELECT count(*) AS n, coalesce(avg(len(ts)), 1.0) AS average FROM t),
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_DOC}) AS token FROM benchmark WHERE item_id % 50 = 0) GROUP BY ALL),
p AS (SELECT id, l, token, count(*) AS tf FROM (SELECT id, len(ts) AS l, unnest(ts) AS token FROM t) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
sc AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / average))), 9) AS score FROM p JOIN d USING (token) JOIN q USING (token), st GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc WHERE score > 0 QUALIFY r <= 30)"""

_NEAR = """
u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
nq AS (SELECT id AS query_id, v AS qv FROM u WHERE id % 50 = 0),
dist AS (SELECT query_id, id, round(1 - list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(v, v)), 12) + 0.0::DOUBLE AS d FROM nq, u),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM dist QUALIFY r <= 30)"""

#: The gate of the hybrid queries; the vectors are spread out, so a wide one opens for them.
GATE = 0.9


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vector.nearest(asked, rows, 30)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index, kept as long as the files are the same."""
    return postings.of_table(spark, table(spark, sf_dir, "documents"), "doc_id")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top(_passages(spark, sf_dir), _index(spark, sf_dir), 30)


@query(f"SELECT doc_id AS id, len({_DOC}) AS len FROM documents")
def doc_length(spark, sf_dir):
    return lexical.lengths(lexical.index(table(spark, sf_dir, "documents"), "doc_id"))


@query(f"SELECT count(*) AS n, round(coalesce(avg(len({_DOC})), 1.0), 6) AS average FROM documents")
def corpus_statistics(spark, sf_dir):
    stats = lexical.statistics(lexical.lengths(lexical.index(table(spark, sf_dir, "documents"), "doc_id")))
    return stats.select("n", F.round("average", 6).alias("average"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_DOC}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT token, count(DISTINCT doc_id) AS df, round(ln(1 + (max(n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM t, n GROUP BY token""")
def document_frequency(spark, sf_dir):
    index = _index(spark, sf_dir)
    counted = postings.frequencies(index).crossJoin(postings.statistics(index).select("n"))  # with one row
    return counted.select("token", "df", F.round(lexical.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query(f"""WITH t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_DOC}) AS token FROM documents) GROUP BY ALL)
SELECT doc_id AS id, count(*) AS n_tokens, max(tf) AS max_tf, sum(tf)::BIGINT AS total_tf FROM t GROUP BY doc_id""")
def postings_summary(spark, sf_dir):
    posts = lexical.postings(lexical.index(table(spark, sf_dir, "documents"), "doc_id"))
    return posts.groupBy("id").agg(F.count("*").alias("n_tokens"), F.max("tf").alias("max_tf"), F.sum("tf").alias("total_tf"))


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, r AS rank FROM lex")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_NEAR} SELECT query_id, id, round(d, 6) AS distance, r AS rank FROM near")
def cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_NEAR} SELECT query_id, id, round(d, 6) AS distance, r AS rank FROM near")
def cosine_clustered_topk(spark, sf_dir):
    """The same nearest vectors, from the clusters that may hold them."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return clusters.nearest(asked, clusters.clustered(rows), 30).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {_NEAR}, l AS (SELECT vec_id AS id, label FROM embeddings)
SELECT label, query_id, id, round(d, 6) AS distance FROM dist JOIN l USING (id) QUALIFY row_number() OVER (PARTITION BY label, query_id ORDER BY d, id) <= 3""")
def cosine_topk_per_label(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vector.nearest(asked, rows, 3, per="label").select("label", "query_id", "id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NEAR} SELECT query_id, count(*) AS candidates, bool_or(d <= 0.5) AS open FROM near GROUP BY query_id")
def domain_gate(spark, sf_dir):
    near = _nearest(spark, sf_dir)
    opened = retrieval.gate(near, 0.5).withColumn("open", F.lit(True))
    return near.groupBy("query_id").agg(F.count("*").alias("candidates")).join(opened, "query_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))


_FUSED = f"""{_BM25}, {_NEAR},
opened AS (SELECT DISTINCT query_id FROM near WHERE d <= {GATE}),
f AS (SELECT coalesce(n.query_id, l.query_id) AS query_id, coalesce(n.id, l.id) AS id, n.d, l.score, coalesce(1.0::DOUBLE / (60 + n.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0) AS rrf
  FROM (SELECT * FROM near WHERE query_id IN (SELECT query_id FROM opened)) n FULL JOIN (SELECT * FROM lex WHERE query_id IN (SELECT query_id FROM opened)) l ON n.query_id = l.query_id AND n.id = l.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(d, 99), coalesce(score, 0) DESC, id) AS position FROM f WHERE d <= {GATE} OR score IS NOT NULL)"""


@query(f"WITH {_FUSED} SELECT query_id, id, position, round(rrf, 9) AS rrf, round(d, 6) AS distance, round(score, 6) AS bm25 FROM fused")
def rrf_fusion(spark, sf_dir):
    hits = retrieval.fuse(_nearest(spark, sf_dir), _lexical(spark, sf_dir), GATE)
    return hits.select("query_id", "id", "position", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"), F.round("bm25", 6).alias("bm25"))


def _reranked(spark, sf_dir, floor):
    hits = retrieval.fuse(_nearest(spark, sf_dir), _lexical(spark, sf_dir), GATE)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = _passages(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    rows = hits.join(docs, "id").join(asked, "query_id")
    return retrieval.rerank(rows, retrieval.overlap_score(bigrams(F.col("question")), bigrams(F.col("text"))), floor=floor)


@query(f"""WITH {_FUSED}, x AS (SELECT f.query_id, f.id, f.position, list_distinct({TOKENS.format("b.text")}) AS qt, list_distinct({TOKENS.format("d.text")}) AS dt
  FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id),
s AS (SELECT query_id, id, position, CASE WHEN position <= 16 THEN ln((len(list_intersect(qt, dt)) + 0.5) / (len(qt) - len(list_intersect(qt, dt)) + 0.5)) END AS score FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position <= 16 THEN 0 ELSE 1 END, score DESC NULLS LAST, position) AS place FROM s)
SELECT query_id, id, place AS position, round(score, 6) AS rerank FROM o WHERE score >= 1.0""")
def rerank_floor(spark, sf_dir):
    return _reranked(spark, sf_dir, 1.0).select("query_id", "id", "position", F.round("rerank", 6).alias("rerank"))


@query()
def near_duplicate_suppression(spark, sf_dir):
    """The first results of each passage among its re-ranked hits, near-duplicates left out."""
    hits = _reranked(spark, sf_dir, None).select("query_id", "position", "id", "text")
    return retrieval.without_near_duplicates(hits, 4).select("query_id", "position", "id")


@query()
def hybrid_search(spark, sf_dir):
    """The whole search with the stand-in embedding on both sides."""
    embed = lambda df: df.withColumn("embedding", F.concat(vector.hashed_embedding(F.col("text"), 63), F.array(F.lit(0.01))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = embed(_passages(spark, sf_dir))
    model = lambda q, t: retrieval.overlap_score(bigrams(q), bigrams(t))
    return retrieval.search(asked, materialize(embed(docs), "embedded"), 0.9, 4, model).select("query_id", "position", "id")


@query(f"""WITH {_NEAR}, best AS (SELECT query_id, min(d) AS d FROM dist WHERE query_id <> id GROUP BY query_id),
k AS (SELECT query_id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'out_of_domain' ELSE 'relevant' END AS kind, d FROM best LEFT JOIN labels ON doc_id = query_id)
SELECT round(max(d) FILTER (kind = 'relevant'), 6) AS max_relevant, round(min(d) FILTER (kind = 'out_of_domain'), 6) AS min_out_of_domain,
  coalesce(max(d) FILTER (kind = 'relevant') <= 0.9, NULL) AND min(d) FILTER (kind = 'out_of_domain') > 0.9 AS separated FROM k""")
def eval_separation(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    best = vector.nearest(asked, rows, 2).where("query_id <> id").groupBy("query_id").agg(F.min("distance").alias("distance"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), "toxic")
    kind = F.when(F.coalesce("toxic", F.lit(0)) == 1, "out_of_domain").otherwise("relevant")
    measured = best.join(labels, "query_id", "left").select(kind.alias("kind"), "distance", F.lit(None).cast("double").alias("bm25"))
    return evaluation.separation(measured, 0.9).select(F.round("max_relevant", 6).alias("max_relevant"), F.round("min_out_of_domain", 6).alias("min_out_of_domain"), "separated")


@query(f"""WITH {_BM25}, top1 AS (SELECT query_id, max(score) AS s FROM lex GROUP BY query_id),
o AS (SELECT query_id, min(d) AS d FROM (SELECT b.item_id AS query_id, round(1 - list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)), 12) AS d
  FROM benchmark b JOIN (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) q ON q.id = b.item_id
  JOIN (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) v ON v.id <> q.id WHERE b.item_id % 50 = 0) GROUP BY query_id),
k AS (SELECT CASE WHEN coalesce(quality, 1) = 0 THEN 'out_of_domain' ELSE 'relevant' END AS kind, d, s FROM o LEFT JOIN top1 USING (query_id) LEFT JOIN labels ON doc_id = query_id)
SELECT round(max(d) FILTER (kind = 'relevant'), 6) AS max_relevant, round(min(d) FILTER (kind = 'out_of_domain'), 6) AS min_out_of_domain,
  round(max(s) FILTER (kind = 'out_of_domain'), 6) AS max_out_bm25, round(min(s) FILTER (kind = 'relevant'), 6) AS min_relevant_bm25 FROM k""")
def eval_both_arms(spark, sf_dir):
    """How far apart relevant and other questions are in both arms, vectors and BM25, each measured over the whole tables."""
    rows = _vectors(spark, sf_dir)
    asked = rows.join(_passages(spark, sf_dir).select("query_id"), F.col("id") == F.col("query_id")).select("query_id", "embedding")
    near = vector.nearest(asked, rows, 2).where("query_id <> id").groupBy("query_id").agg(F.min("distance").alias("distance"))
    best = _lexical(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("bm25"))
    kind = F.when(F.coalesce("quality", F.lit(1)) == 0, "out_of_domain").otherwise("relevant")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), "quality")
    measured = near.join(best, "query_id", "left").join(labels, "query_id", "left").select(kind.alias("kind"), "distance", "bm25")
    out = evaluation.separation(measured, 0.9)
    return out.select(*[F.round(c, 6).alias(c) for c in ("max_relevant", "min_out_of_domain", "max_out_bm25", "min_relevant_bm25")])


@query(f"""WITH {_BM25}, h AS (SELECT item_id AS q, count(lex.id) AS n FROM benchmark LEFT JOIN lex ON query_id = item_id WHERE item_id % 50 = 0 GROUP BY item_id)
SELECT count(*) FILTER (n = 0) AS lost, 0::BIGINT AS leaked, count(*) FILTER (n > 0 AND q % 100 = 50) AS missing, count(*) FILTER (n = 0) = 0 AND count(*) FILTER (n > 0 AND q % 100 = 50) = 0 AS passed FROM h""")
def eval_verdict(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"))
    hits = _lexical(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    results = asked.join(hits, "query_id", "left").select(F.lit("relevant").alias("kind"), F.coalesce("n", F.lit(0)).alias("n_hits"), (F.col("query_id") % 100 != 50).alias("expected_found"))
    return evaluation.verdict(results)


@query(f"""WITH {_BM25}, e AS (SELECT l.query_id, l.r AS position, l.id::VARCHAR AS citation, d.text FROM lex l JOIN documents d ON d.doc_id = l.id),
u AS (SELECT query_id, position, citation, sum(length(citation) + length(coalesce(text, '')) + length(position::VARCHAR) + 6) OVER (PARTITION BY query_id ORDER BY position) AS used FROM e)
SELECT query_id, position, citation, used::BIGINT AS used FROM u WHERE used <= 28000""")
def evidence_budget(spark, sf_dir):
    """Each passage's BM25 hits as evidence, as far as a prompt has room."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _lexical(spark, sf_dir).join(docs, "id").select("query_id", F.col("rank").alias("position"), F.col("id").cast("string").alias("citation"), "text")
    return render.within_budget(hits).select("query_id", "position", "citation", "used")
