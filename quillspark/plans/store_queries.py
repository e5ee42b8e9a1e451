"""Folding, joins and change detection of the store over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, store
from ..sources import docs as doc_sources
from .registry import query, table


@query("SELECT sha256(text) AS chunk_id, count(*) AS n_occurrences, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def fold_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("chunk_id")).agg(F.count("*").alias("n_occurrences"), F.min("doc_id").alias("first_doc"))


def _tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    occurrences = docs.select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("chunk_id"), "source", F.to_json(F.struct(F.col("doc_id").alias("location"))).alias("metadata"))
    chunks = docs.groupBy(F.sha2("text", 256).alias("id")).agg(F.first("text").alias("text"))
    return chunks, occurrences


@query("""SELECT sha256(text) AS chunk_id, count(*) - 1 AS others, list(source ORDER BY source, doc_id::VARCHAR)[1] AS first_source, list(doc_id::VARCHAR ORDER BY source, doc_id::VARCHAR)[1] AS first_id
FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)""")
def chunk_occurrences(spark, sf_dir):
    found = store.with_occurrences(*_tables(spark, sf_dir))
    return found.select("chunk_id", (F.col("n") - 1).alias("others"), F.col("first.source").alias("first_source"), F.col("first.id").alias("first_id"))


@query("SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def orphan_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    children = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("chunk_id"))
    return store.orphans(parents, children)


@query("""SELECT (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS orphans,
(SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS dangling""")
def integrity(spark, sf_dir):
    return store.integrity(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT doc_id AS id, text IS NULL AS is_null, d.pos FROM documents JOIN (SELECT item_id AS doc_id, 1000 - item_id AS pos FROM benchmark) d USING (doc_id)")
def get_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (1000 - F.col("item_id")).alias("pos"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").isNull().alias("is_null"))
    return store.get_by_ids(rows, ids)


@query("""SELECT doc_id AS id, 'new' AS origin FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, 'old' FROM documents WHERE coalesce(source, '') <> 'src3'""")
def replace_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    old, new = docs.withColumn("origin", F.lit("old")), docs.where("source = 'src3'").withColumn("origin", F.lit("new"))
    return store.merged(old, new).select("id", "origin")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT 'src' || r_regionkey::VARCHAR FROM region) AND source NOT LIKE 'uploads/%'")
def source_difference(spark, sf_dir):
    indexed = table(spark, sf_dir, "documents").select("source").distinct()
    known = table(spark, sf_dir, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("source"))
    return indexed.join(known, "source", "left_anti").where(~F.col("source").startswith("uploads/"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def unchanged_skip(spark, sf_dir):
    """Documents whose digest differs from the stored one, a third of which are stored with another."""
    from ..functions.text import file_digest
    from ..sources.files import changed

    docs = table(spark, sf_dir, "documents")
    digest = lambda text: file_digest(F.coalesce(text, F.lit("")).cast("binary"))
    found = docs.select(F.col("doc_id").alias("source"), digest(F.col("text")).alias("file_hash"))
    stored = docs.select(F.col("doc_id").alias("source"), digest(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit("!")).otherwise(F.lit("")))).alias("file_hash"))
    return changed(found, stored).select(F.col("source").alias("doc_id"))


@query("SELECT doc_id::VARCHAR || '.md' AS name FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def page_change_detection(spark, sf_dir):
    """Pages to write: new ones, and those whose body changed; a new date in the front matter alone is no change."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("body"))
    page = lambda day, body: F.concat(F.lit(f"---\nfetched_at: {day}\n---\n"), body)
    pages = docs.select("name", page("2026-02-02", F.col("body")).alias("text"))
    stored = docs.where("doc_id % 7 <> 0").select("name", page("2026-01-01", F.when(F.col("doc_id") % 5 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body"))).alias("text"))
    return doc_sources.changed_pages(pages, stored).select("name")


@query("SELECT source, lang AS status, count(*) AS n FROM documents GROUP BY source, lang")
def ingest_report(spark, sf_dir):
    found = evaluation.report(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")
    return found.select("source", F.col("lang").alias("status"), "n")


@query("""SELECT source, count(*) FILTER (lang = 'en') AS written, count(*) FILTER (lang = 'de') AS failed, count(*) FILTER (lang NOT IN ('en', 'de')) AS empty, sum(doc_id % 3)::BIGINT AS unresolved FROM documents GROUP BY source""")
def fetch_report(spark, sf_dir):
    status = F.when(F.col("lang") == "en", "written").when(F.col("lang") == "de", "failed").otherwise("empty")
    return doc_sources.fetch_report(table(spark, sf_dir, "documents").select("source", status.alias("status"), (F.col("doc_id") % 3).alias("unresolved")))
