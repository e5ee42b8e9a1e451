"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (ASCII letters lower-cased, digits made 0, white space collapsed) and hashed; for each host (the
``source`` column) the documents with each line are counted. A line in more documents than both ``min_docs`` and ``min_share`` of
the host's documents is removed; a document left with too few words, or too small a part of them, is rejected. Some rules on
the document alone come first (``base_failed``).

Counting combines on the map side, so a line in every document of a large host costs a row per task. Texts are read once
and not shuffled: measures, line hashes and word counts are written and used from there. Null texts have no words and fail; a null source is a host of its
own; repeated rows count as documents of their own; an empty table gives no rows. Only doc_id, source and text are read, so
extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised(line: Column) -> Column:
    """The form in which lines are compared."""
    plain = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(plain, SPACE, " "))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, _host, the base measures, and _lines array<struct<h, w>>: hash and words of each line that has a word."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_host"), text.alias("_text"))
    d = d.select(
        "doc_id",
        "_host",
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0).alias("_raw"),
    )
    starts = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    windows = F.when(F.size("_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW)))))
    d = d.select(
        "doc_id",
        "_host",
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
        F.transform("_raw", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))).alias("_lines"),
    )
    # Only texts that repeat a window at all have their windows sorted; neighbours in that order are the repeats.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, by: F.coalesce(F.get("_sorted", i + by)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_hits", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])))
    steps = F.transform("_hits", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_hits", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return d.select("doc_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "_lines")


def _document_lines(measured: DataFrame) -> DataFrame:
    """(doc_id, _host, _h): each document's lines once."""
    return measured.select("doc_id", "_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_h"))


def frequent_lines(measured: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(_host, _h, _docs): lines in more documents of their host than either limit."""
    hosts = measured.groupBy("_host").agg(F.count("*").alias("_host_docs"))
    counted = _document_lines(measured).groupBy("_host", "_h").agg(F.count("*").alias("_docs")).where(F.col("_docs") > min_docs)
    return counted.join(hosts, "_host").where(F.col("_docs") > F.col("_host_docs") * min_share).select("_host", "_h", "_docs")


def _marked(measured: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(_id, _where, _frequent): the frequent lines of each document that has any; a null doc_id is a fixed number."""
    found = _document_lines(measured).join(frequent_lines(measured, min_docs, min_share), ["_host", "_h"], "left_semi")
    return found.groupBy(_key().alias("_id"), F.col("_host").alias("_where")).agg(F.collect_set("_h").alias("_frequent"))


def _key() -> Column:
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def _judged(measured: DataFrame, marked: DataFrame, min_words: int, min_left: float, max_repeat: float) -> DataFrame:
    d = measured.join(marked, (_key() == F.col("_id")) & (F.col("_host") == F.col("_where")), "left")
    gone = F.filter("_lines", lambda x: F.array_contains(F.coalesce("_frequent", F.array().cast("array<bigint>")), x["h"]))
    d = d.withColumn("_gone", F.when(F.col("_frequent").isNotNull(), gone))
    d = d.withColumn("n_removed_words", F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, x: a + x["w"]), F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        "n_removed_words",
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_removed_lines"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def judge(docs: DataFrame, min_docs: int = 10, min_share: float = 0.002, min_words: int = 20, min_left: float = 0.5, max_repeat: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, base measures, base_failed, n_removed_words, n_removed_lines, kept.

    Texts are read once: counting, marking and judging all work on the written measures.
    """
    measured = materialize(measures(docs), "line-measures")
    return _judged(measured, _marked(measured, min_docs, min_share), min_words, min_left, max_repeat)


def clean(docs: DataFrame, min_docs: int = 10, min_share: float = 0.002, min_words: int = 20, min_left: float = 0.5, max_repeat: float = 0.3) -> DataFrame:
    """docs that are kept, their text without the frequent lines. Needs doc_id to be unique and not null."""
    measured = materialize(measures(docs), "line-measures")
    marked = _marked(measured, min_docs, min_share)
    kept = _judged(measured, marked, min_words, min_left, max_repeat).where("kept").select(F.col("doc_id").alias("_kept"))
    rows = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").join(marked, F.col("doc_id") == F.col("_id"), "left")
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_frequent", F.xxhash64(normalised(x))))
    return rows.withColumn("text", F.when(F.col("_frequent").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))).drop("_id", "_where", "_frequent")


#: The same rows in DuckDB SQL, with the lines themselves in place of their hashes.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d),
ln AS (SELECT doc_id, host, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
  trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS nl
  FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT l.host, l.nl FROM (SELECT host, nl, count(*) AS n FROM (SELECT DISTINCT doc_id, host, nl FROM ln) GROUP BY host, nl) l JOIN hosts h ON h.host = l.host WHERE l.n > 10 AND l.n > h.docs * 0.002),
gone AS (SELECT doc_id, sum(n) AS words, count(*) AS lines FROM ln JOIN freq ON ln.host = freq.host AND ln.nl = freq.nl GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
  length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(gone.words, 0)::BIGINT AS n_removed_words, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_removed_words, n_removed_lines,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.5 * n_words) AS kept
FROM m
"""
