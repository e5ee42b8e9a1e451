"""Not-modified revisits resolved to the response they stand for.

Each revisit is matched, as of its time, with the latest earlier full response of the same canonical URL. The match counts
only if the validators agree: the entity tag if both sides have one (weak marks don't matter), else the modification
date if both have one, else the payload digest. The stored headers are then updated with those that a not-modified answer
may change.

The as-of join deals rows by URL and slice of time: the last response of each (URL, slice) is carried to later slices in a
window over these few rows, and within a slice a window finishes the job, so one URL with a third of all captures is
spread over many tasks. Slices lie between sampled quantiles of time and are cut evenly again as the captures grow, to about
``SLICE_ROWS`` captures each.

A capture with null URL or time is an ``unplaced`` revisit; other outcomes are ``resolved``, ``no_response`` and ``mismatch``.
Captures at the same time aren't earlier; of responses at one time the largest record_id counts. Repeated rows are
resolved each. Header names are compared in lower case; of repeated names the first counts. Other columns aren't
read, so they can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that replace the stored ones (fixed values).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't name a resource (fixed values).
TRACKING = "^(utm_[^=]*|gclid|fbclid|msclkid|sessionid|phpsessid)(=|$)"
SLICES, SLICE_ROWS = 64, 100_000


def canonical_url(url: Column) -> Column:
    """Host and rest in one spelling: no scheme, fragment, default port, www or tracking parameters; sorted parameters."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def header_list(headers: Column) -> Column:
    """Map of headers -> array of (key, value) with lower-case names, the first of each name."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["key"] == e["key"])
    return F.coalesce(F.filter(entries, first), F.array().cast("array<struct<key:string,value:string>>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored (key, value) entries updated with the permitted ones among the fresh, sorted by key."""
    new = F.filter(fresh, lambda e: e["key"].isin(PERMITTED))
    old = F.filter(stored, lambda e: ~F.exists(new, lambda n: n["key"] == e["key"]))
    return F.array_sort(F.concat(old, new))


def resolve(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of captures (record_id, url, ts, kind, etag, last_modified, digest, headers map).

    Gives (record_id, url_key, ts, outcome, response_id, response_digest, headers array<struct<key, value>>).
    """
    entry = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", header_list(F.col("headers")).alias("headers")))
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "ts", "kind", "etag", "last_modified", "digest", canonical_url(F.col("url")).alias("url_key"), header_list(F.col("headers")).alias("_fresh"), entry.alias("_entry")
    )
    placed = rows.where("url_key is not null and ts is not null")
    # Edges of even slices of time, by sampled quantiles: a bounded list, and any edges give the same result.
    time = F.col("ts").cast("double")
    n, low, high, edges = placed.agg(F.count("*"), F.min(time), F.max(time), F.percentile_approx(time, [i / slices for i in range(1, slices)], 1_000)).first()
    finer = max(1, n // (slices * SLICE_ROWS))
    points = F.array(*[F.lit(float(x)) for x in sorted({low or 0.0, *(edges or [])})])
    coarse = F.size(F.filter(points, lambda e: e <= time))  # from 1
    start, width = F.element_at(points, F.greatest(coarse, F.lit(1))), F.coalesce(F.get(points, coarse), F.lit(float(high or 0.0))) - F.element_at(points, F.greatest(coarse, F.lit(1)))
    part = F.least(F.floor((time - start) / F.when(width > 0, width).otherwise(F.lit(1.0)) * finer), F.lit(finer - 1))
    placed = placed.withColumn("_slice", coarse.cast("long") * finer + (part if finer > 1 else F.lit(0)))

    last_in = placed.where("kind = 'response'").groupBy("url_key", "_slice").agg(F.max_by("_entry", F.struct("ts", "record_id")).alias("_last"))
    slots = placed.select("url_key", "_slice").distinct().join(last_in, ["url_key", "_slice"], "left")
    earlier = Window.partitionBy("url_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(F.col("url_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    inside = Window.partitionBy("url_key", "_slice").orderBy("ts", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    # At one time revisits come before responses, so only earlier responses are seen.
    found = placed.join(carried, (F.col("url_key") == F.col("_k")) & (F.col("_slice") == F.col("_s"))).withColumn("_seen", F.coalesce(F.last("_entry", ignorenulls=True).over(inside), F.col("_carried")))
    lost = rows.where("url_key is null or ts is null").withColumn("_seen", F.lit(None).cast(rows.schema["_entry"].dataType))
    columns = ["record_id", "url_key", "ts", "kind", "etag", "last_modified", "digest", "_fresh", "_seen"]
    revisits = found.select(*columns).unionByName(lost.select(*columns)).where("kind = 'revisit'")

    opaque = lambda tag: F.regexp_replace(tag, "^W/", "")
    s = F.col("_seen")
    agree = (
        F.when(F.col("etag").isNotNull() & s["etag"].isNotNull(), opaque(F.col("etag")) == opaque(s["etag"]))
        .when(F.col("last_modified").isNotNull() & s["last_modified"].isNotNull(), F.col("last_modified") == s["last_modified"])
        .otherwise(F.coalesce(F.col("digest") == s["digest"], F.lit(False)))
    )
    outcome = F.when(F.col("url_key").isNull() | F.col("ts").isNull(), "unplaced").when(s.isNull(), "no_response").when(agree, "resolved").otherwise("mismatch")
    done = revisits.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "url_key", "ts", "outcome",
        F.when(ok, s["record_id"]).alias("response_id"),
        F.when(ok, s["digest"]).alias("response_digest"),
        F.when(ok, merged_headers(s["headers"], F.col("_fresh"))).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Two captures per page, as a crawler would have met it: a full response and a later not-modified answer.

    The answer uses a spelling of the URL with a tracking parameter and a fragment. A part of the answers carries a
    validator that doesn't fit, and a part comes before the page's own response.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    common = pages.select("page_id", "url", tag.alias("tag"), size.alias("size"))
    etag = F.when(p % 5 == 4, None).otherwise(F.col("tag"))
    modified = p.cast("string")
    response = F.struct(
        (p * 2).alias("record_id"), F.col("url").alias("url"), (p * 10).alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), modified.alias("last_modified"), F.col("tag").alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Date"), (p * 10).cast("string"), F.lit("ETag"), F.col("tag")).alias("headers"),
    )
    variant = F.concat("url", F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_campaign=again#top"))
    sent = F.when(p % 5 == 4, None).when(p % 7 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), "tag"))
    revisit = F.struct(
        (p * 2 + 1).alias("record_id"), variant.alias("url"), F.when(p % 11 == 5, p * 10 - 5).otherwise(p * 10 + 7).alias("ts"), F.lit("revisit").alias("kind"), sent.alias("etag"), modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (p * 10 + 7).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    return common.select(F.explode(F.array(response, revisit)).alias("c")).select("c.*")


#: The query's rows in DuckDB SQL.
ORACLE = r"""
WITH p AS (SELECT page_id AS p, url, '"' || md5(coalesce(html, '')) || '"' AS tag, octet_length(encode(coalesce(html, '')))::VARCHAR AS size FROM pages),
c AS (SELECT p * 2 AS id, url, p * 10 AS ts, true AS full_one, CASE WHEN p % 5 = 4 THEN NULL ELSE tag END AS etag, p::VARCHAR AS lm, tag, size, p FROM p
  UNION ALL SELECT p * 2 + 1, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=again#top', CASE WHEN p % 11 = 5 THEN p * 10 - 5 ELSE p * 10 + 7 END, false,
  CASE WHEN p % 5 = 4 THEN NULL WHEN p % 7 = 3 THEN '"changed"' ELSE tag END, p::VARCHAR, NULL, NULL, p FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid|sessionid|phpsessid)(=|$)'))) AS q FROM b),
u AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
s AS (SELECT *, last_value(CASE WHEN full_one THEN {'id': id, 'etag': etag, 'lm': lm, 'tag': tag, 'size': size} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, full_one, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u),
o AS (SELECT *, CASE WHEN r IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN etag = r.etag THEN 'resolved' ELSE 'mismatch' END WHEN lm = r.lm THEN 'resolved' ELSE 'mismatch' END AS outcome FROM s WHERE NOT full_one)
SELECT id AS record_id, url_key, ts, outcome, CASE WHEN outcome = 'resolved' THEN r.id END AS response_id, CASE WHEN outcome = 'resolved' THEN r.tag END AS response_digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (p * 10 + 7)::VARCHAR || chr(10) || 'etag: ' || r.tag END AS merged_headers
FROM o
"""
