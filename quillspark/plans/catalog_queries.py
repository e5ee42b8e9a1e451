"""Catalogue algebra over parts, suppliers and event properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, evaluation
from ..operators.catalog import Ranking
from ..operators.predicate import column_value, compile_where, variant_value
from ..operators.tables import numbered
from .registry import query, table

CONDITIONS = {"p_size": {"$lte": 25}, "p_retailprice": {"$gte": 930.0}, "p_brand": {"$eq": "Brand#13"}}
BY_PRICE = Ranking("p_retailprice", True)
_C = ["p_size <= 25", "p_retailprice >= 930", "p_brand = 'Brand#13'"]
_P = "SELECT p_partkey::VARCHAR AS source, p_brand, p_size, p_retailprice FROM part"


def _products(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), "p_brand", "p_size", "p_retailprice")


@query(f"WITH p AS ({_P}) SELECT source, p_size, round(p_retailprice, 4) AS price FROM p WHERE {' AND '.join(_C)}")
def catalog_select(spark, sf_dir):
    return catalog.select(_products(spark, sf_dir), CONDITIONS).select("source", "p_size", F.round("p_retailprice", 4).alias("price"))


@query(f"""WITH p AS ({_P}) SELECT 'p_size' AS dropped, source FROM p WHERE NOT {_C[0]} AND {_C[1]} AND {_C[2]}
UNION ALL SELECT 'p_retailprice', source FROM p WHERE {_C[0]} AND NOT {_C[1]} AND {_C[2]} UNION ALL SELECT 'p_brand', source FROM p WHERE {_C[0]} AND {_C[1]} AND NOT {_C[2]}""")
def catalog_relaxations(spark, sf_dir):
    return catalog.relaxations(_products(spark, sf_dir), CONDITIONS).select("dropped", "source")


@query(f"WITH p AS ({_P}) SELECT source, round(p_retailprice, 4) AS price FROM p WHERE NOT ({' AND '.join(_C)}) AND p_retailprice > (SELECT max(p_retailprice) FROM p WHERE {' AND '.join(_C)})")
def catalog_exceeding(spark, sf_dir):
    return catalog.exceeding(_products(spark, sf_dir), CONDITIONS, BY_PRICE).select("source", F.round("p_retailprice", 4).alias("price"))


@query(f"WITH p AS ({_P}) SELECT source, row_number() OVER (ORDER BY p_retailprice DESC, source) AS place FROM p WHERE {' AND '.join(_C)}")
def catalog_ranked(spark, sf_dir):
    found = catalog.select(_products(spark, sf_dir), CONDITIONS)
    return numbered(found, catalog.rank_order(found, BY_PRICE)).select("source", F.col("number").alias("place"))


@query(f"""WITH p AS ({_P}) SELECT source, source || ' | p_size=' || p_size::VARCHAR || ' | p_brand=' || p_brand AS line FROM p WHERE p_size <= 3 AND p_brand = 'Brand#13'""")
def catalog_row_text(spark, sf_dir):
    conditions = {"p_size": {"$lte": 3}, "p_brand": {"$eq": "Brand#13"}}
    found = catalog.select(_products(spark, sf_dir).drop("p_retailprice"), conditions)
    return found.select("source", catalog.row_text(found, conditions, Ranking("p_size", False)).alias("line"))


@query("""WITH f AS (SELECT p_brand AS source, arg_min(struct_pack(s := p_size, t := p_type), p_partkey) AS a FROM part WHERE p_brand <> '' GROUP BY p_brand) SELECT source, a.s AS p_size, a.t AS p_type FROM f""")
def product_fold(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").withColumn("source", F.col("p_brand"))
    return catalog.fold(chunks, ["p_size", "p_type"], "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size <= 15 AND p_type >= 'M' AND p_brand = 'Brand#22'")
def where_compiler(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    where = {"$and": [{"p_size": {"$gte": 5, "$lte": 15}}, {"p_type": {"$gte": "M"}}], "p_brand": "Brand#22"}
    return part.where(compile_where(where, column_value(dict(part.dtypes)))).select("p_partkey")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::DOUBLE >= 50 AND event_type = 'click'")
def where_variant(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("attributes", F.try_parse_json("props"))
    return events.where(compile_where({"k": {"$gte": 50}}, variant_value("attributes"))).where("event_type = 'click'").select("event_id")


@query("""WITH e AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events)
SELECT key, CASE WHEN arg_min(json_type(props, '$.' || key), event_id) = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM e GROUP BY key""")
def attribute_schema(spark, sf_dir):
    return catalog.available_keys(table(spark, sf_dir, "events"), "props", "event_id")


@query("""SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.9), 6) AS p90, round(quantile_disc(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    found = evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p50", "p90", "p99", "mean")])


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE value < 5 GROUP BY event_type")
def failure_reasons(spark, sf_dir):
    return evaluation.failures(table(spark, sf_dir, "events").where("value < 5").withColumnRenamed("event_type", "reason"), "reason")
