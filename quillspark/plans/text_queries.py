"""Parsing, chunking and text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import render, text
from ..operators import chunking, evaluation, navigation
from ..sources import html
from .registry import query, table


@query()
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_matches(substr(lower(ltrim(html, chr(32) || chr(9) || chr(10) || chr(13))), 1, 200), '^(<!doctype html|<html|<\\?xml)') AS is_html FROM pages""")
def html_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.looks_like_html(F.lit("text/plain"), F.col("html")).alias("is_html"))


@query()
def chunk_documents(spark, sf_dir):
    """Every document split into chunks."""
    units = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.lit("document").alias("location_type"), F.lit(0).alias("location"), F.lit(0).alias("unit_seq"), "text")
    return chunking.chunk(units).select("id", "source", "chunk_index", "text")


@query()
def chunk_code_documents(spark, sf_dir):
    """Every document split into chunks, code blocks kept whole."""
    units = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.lit("document").alias("location_type"), F.lit(0).alias("location"), F.lit(0).alias("unit_seq"), "text")
    return chunking.chunk(units, keep_code=True).select("id", "source", "chunk_index", "text")


@query("""WITH s AS (SELECT doc_id, text, length(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) AS l FROM documents WHERE length(text) <= 800)
SELECT doc_id, length(text)::BIGINT AS n FROM s WHERE l >= 10""")
def chunk_short_documents(spark, sf_dir):
    """Documents that stay whole: at most 800 characters, at least ten of them not at the ends."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") <= 800)
    return docs.select("doc_id", F.explode(chunking.parts_of(F.col("text"))).alias("part")).select("doc_id", F.length("part").cast("long").alias("n"))


@query(r"""WITH u AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN doc_id::VARCHAR || chr(10) || 'Heading' WHEN doc_id % 10 = 1 THEN '目次' || chr(10) || coalesce(text, '') WHEN doc_id % 10 = 2 THEN 'ご清聴ありがとう' ELSE coalesce(text, '') END AS t FROM documents),
b AS (SELECT doc_id, source, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM u),
l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS ls, len(string_split(t, chr(10))) AS raw FROM b),
n AS (SELECT *, (raw <= 4 AND len(ls) >= 2 AND regexp_matches(ls[1], '^\d+$') AND len(list_filter(ls[2:], lambda x: regexp_matches(x, '^\d+$'))) = 0) OR coalesce(contains(ls[1], '目次') AND length(ls[1]) <= 10, false) OR (starts_with(t, 'ご清聴') AND length(t) <= 60) AS nav FROM l)
SELECT doc_id, nav AS is_nav, nav AND NOT bool_and(nav) OVER (PARTITION BY source) AS dropped FROM n""")
def navigation_filter(spark, sf_dir):
    """Documents as slides, some of them made into dividers, contents and closings."""
    body = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 10
    shaped = F.when(kind == 0, F.concat(F.col("doc_id").cast("string"), F.lit("\nHeading"))).when(kind == 1, F.concat(F.lit("目次\n"), body)).when(kind == 2, F.lit("ご清聴ありがとう")).otherwise(body)
    return navigation.marked(table(spark, sf_dir, "documents").select("doc_id", "source", shaped.alias("text"))).select("doc_id", "is_nav", "dropped")


@query("""SELECT conv_id, turn, CASE WHEN p IS NULL THEN text ELSE p || ' ' || text END AS query FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations)""")
def contextual_query(spark, sf_dir):
    """Each turn after the last user turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(last.isNull(), F.col("text")).otherwise(F.concat(last, F.lit(" "), "text")).alias("query"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') || '36協定 三六協定について' WHEN turn % 3 = 1 THEN coalesce(text, '') || '36協定 三六協定について' ELSE coalesce(text, '') END AS query FROM conversations""")
def synonym_expansion(spark, sf_dir):
    """Turns with a known variant, with it and its expansion, and with neither."""
    kind, body = F.col("turn") % 3, F.coalesce("text", F.lit(""))
    asked = F.concat(body, F.when(kind == 0, F.lit("36協定")).when(kind == 1, F.lit("36協定 三六協定について")).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.expand_synonyms(asked).alias("query"))


@query("""SELECT conv_id, turn, coalesce(text, '') || '・a。 ' AS answer FROM conversations""")
def answer_clean(spark, sf_dir):
    """Turns dressed as a model's answer, its label and list tags taken off."""
    dressed = F.concat(F.lit("答え： "), F.coalesce("text", F.lit("")), F.lit("<br /><UL><li>a。</li></ul>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_list_tags(text.strip_label(dressed)).alias("answer"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'mermaid' WHEN 1 THEN 'markdown' END AS mode FROM conversations""")
def display_mode(spark, sf_dir):
    kind = F.col("turn") % 4
    asked = F.when(kind == 0, F.lit("図をMermaid記法で出力して")).when(kind == 1, F.lit("マークダウンで表示")).when(kind == 2, F.lit("mermaid とは何か")).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.display_mode(asked).alias("mode"))


@query("""SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN ' p.' || doc_id::VARCHAR WHEN 1 THEN ' スライド' || doc_id::VARCHAR WHEN 2 THEN ' ＞ ' || lang ELSE '' END || CASE WHEN doc_id % 8 = 0 THEN '（OCR）' ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN ' ほか' || (doc_id % 3)::VARCHAR || '資料' ELSE '' END AS citation FROM documents""")
def citation(spark, sf_dir):
    kind = F.col("doc_id") % 4
    at = F.when(kind == 0, "page").when(kind == 1, "slide").when(kind == 2, "section").otherwise("document")
    first = render.place(F.col("source"), at, F.col("doc_id"), F.col("lang"), F.col("doc_id") % 8 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", render.citation(first, F.col("doc_id") % 3 + 1).alias("citation"))


@query("""SELECT event_id, 'e ／ ' || CASE WHEN event_id % 3 = 0 THEN 'cosine距離 未計測（BM25で採用）' ELSE 'cosine距離 ' || printf('%.3f', 0.125 * (event_id % 5)) || '（しきい値 0.5）' END || ' ／ ' || CASE WHEN event_id % 3 = 1 THEN 'BM25 一致なし' ELSE 'BM25 ' || printf('%.2f', 0.25 * (event_id % 9)) END || ' ／ Reranker 未計測' AS caption FROM events""")
def hit_caption(spark, sf_dir):
    e = F.col("event_id")
    distance, score = F.when(e % 3 != 0, 0.125 * (e % 5)), F.when(e % 3 != 1, 0.25 * (e % 9))
    return table(spark, sf_dir, "events").select("event_id", render.hit_caption(F.lit("e"), distance, score, F.lit(None).cast("double")).alias("caption"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS s FROM events")
def sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(text.sigmoid((F.col("value") - 50) / 10), 9).alias("s"))


@query("""SELECT doc_id, coalesce(text, '') AS body, lang AS title, ['a', 'b'] AS marks FROM documents""")
def page_text(spark, sf_dir):
    """Documents wrapped with front matter, Liquid tags and marks, and unwrapped again."""
    body = F.coalesce("text", F.lit(""))
    page = F.concat(F.lit("---\ntitle: "), F.col("lang"), F.lit("\n---\n"), F.lit("{% include x %}"), body)
    marked = F.lit("{{a}} {{ b }} {{a}}")
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_liquid(text.without_frontmatter(page)).alias("body"), text.title_of(page, F.lit("?")).alias("title"), text.mark_names(marked).alias("marks"))


@query("""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS line FROM documents""")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapsed(F.coalesce("text", F.lit(""))).alias("line"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'short' ELSE coalesce(text, '') END AS query FROM conversations""")
def reply_parsing(spark, sf_dir):
    """The query of a JSON reply, or the question where the reply is broken or lacks one."""
    kind = F.col("turn") % 3
    reply = F.when(kind == 0, F.lit('{"query": " \\"short\\" "}')).when(kind == 1, F.lit("{broken")).otherwise(F.lit('{"other": 1}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", render.reply_query(reply, F.coalesce("text", F.lit(""))).alias("query"))


@query("""SELECT coalesce(bool_or(query <> text), false) AS worked FROM (SELECT text, CASE WHEN p IS NULL THEN text ELSE p || ' ' || text END AS query FROM
(SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations))""")
def translation_worked(spark, sf_dir):
    """Whether any turn is searched in other words than its own."""
    asked = contextual_query(spark, sf_dir).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return evaluation.translation_worked(own.join(asked, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))))


@query("""SELECT event_id, event_ns / 1e9 AS seconds FROM (SELECT event_id, (value * 1e6)::BIGINT AS event_ns FROM events)""")
def reply_seconds(spark, sf_dir):
    """Durations of JSON replies made from the events' values."""
    reply = F.to_json(F.struct(F.round(F.col("value") * 1e6).cast("long").alias("total_duration")))
    return table(spark, sf_dir, "events").select("event_id", text.seconds_of(reply, "total_duration").alias("seconds"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'a/img/' || page_id::VARCHAR || '.png' WHEN page_id % 4 = 1 THEN page_id::VARCHAR || '.png' END AS path FROM pages""")
def image_references(spark, sf_dir):
    """References of pages in a folder: below it, beside it, outside the root, and each page's own remote address."""
    p = F.col("page_id")
    name = F.concat(p.cast("string"), F.lit(".png"))
    target = F.when(p % 4 == 0, F.concat(F.lit("./img/"), name)).when(p % 4 == 1, F.concat(F.lit("../"), name)).when(p % 4 == 2, F.concat(F.lit("../../a/"), name)).otherwise(F.concat(F.lit("https://x.example/"), name))
    return table(spark, sf_dir, "pages").select("page_id", text.local_reference(F.lit("a/page.md"), target).alias("path"))


@query("""SELECT conv_id AS source, turn AS number, base || CASE WHEN n = 1 THEN '' ELSE '(' || n::VARCHAR || ')' END AS sheet
FROM (SELECT conv_id, turn, 'Turn ' || role AS base, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) AS n FROM conversations)""")
def sheet_names(spark, sf_dir):
    """Turns as worksheets of their conversation's workbook, named by role."""
    titles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("number"), F.concat(F.lit("Turn "), "role").alias("title"))
    return text.unique_sheet_names(titles).select("source", "number", "sheet")
