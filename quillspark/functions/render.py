"""Citations, captions, prompts and tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import sigmoid


def place(source: Column, location_type: Column, location: Column, heading: Column, ocr: Column) -> Column:
    """One occurrence as a citation."""
    named = lambda before, after: F.concat(source, F.lit(before), heading, F.lit(after))
    has_heading = F.coalesce(heading, F.lit("")) != ""
    at = (
        F.when(location_type == "page", F.concat(source, F.lit(" p."), location.cast("string")))
        .when(location_type == "slide", F.concat(source, F.lit(" スライド"), location.cast("string")))
        .when((location_type == "sheet") & has_heading, named(" シート「", "」"))
        .when((location_type == "diagram") & has_heading, named(" 図「", "」"))
        .when((location_type == "section") & has_heading, named(" ＞ ", ""))
        .otherwise(source)
    )
    return F.concat(at, F.when(F.coalesce(ocr, F.lit(False)), F.lit("（OCR）")).otherwise(F.lit("")))


def citation(first: Column, n_occurrences: Column) -> Column:
    """The representative place and how many other documents hold the text."""
    return F.when(n_occurrences > 1, F.concat(first, F.lit(" ほか"), (n_occurrences - 1).cast("string"), F.lit("資料"))).otherwise(first)


def hit_caption(cited: Column, distance: Column, bm25: Column, rerank: Column, threshold: float = 0.5) -> Column:
    """Where a hit comes from and what each arm measured; null means not measured."""
    d = F.when(distance.isNull(), F.lit("cosine距離 未計測（BM25で採用）")).otherwise(F.concat(F.lit("cosine距離 "), F.format_string("%.3f", distance), F.lit(f"（しきい値 {threshold}）")))
    b = F.when(bm25.isNull(), F.lit("BM25 一致なし")).otherwise(F.format_string("BM25 %.2f", bm25))
    r = F.when(rerank.isNull(), F.lit("Reranker 未計測")).otherwise(F.format_string("Reranker %.2f", sigmoid(rerank)))
    return F.concat_ws(" ／ ", cited, d, b, r)


def evidence_prompt(question: Column, hits: Column, intro: str, nothing: str) -> Column:
    """Prompt of numbered evidence; hits is an ordered array of struct<citation, text>."""
    blocks = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["citation"], F.lit("\n"), h["text"]))
    body = F.when(F.size(hits) > 0, F.concat_ws("\n\n", blocks)).otherwise(F.lit(nothing))
    return F.concat_ws("\n\n", F.lit(intro), body, F.concat(F.lit("質問: "), question))


#: Characters of evidence that a prompt may hold (fixed value).
MOST_EVIDENCE = 28_000
#: Per kind of question what comes before the evidence, and what stands in its place where there is none.
KINDS = {
    "internal": (
        "次の社内資料だけを根拠に答えてください。資料にない事実や主体は補わず、足りなければ答えられないと伝えてください。出典の表記は本文に書かないでください。",
        "社内資料に該当する記述はありませんでした。推測せず、資料からは答えられないと伝えてください。",
    ),
    "docs": (
        "次の公式ドキュメントの記法だけで答えてください。古い書き方を混ぜず、載っていない関数名・引数・設定は補わないでください。出典の表記は本文に書かないでください。",
        "公式ドキュメントに該当する記述はありませんでした。推測せず、ドキュメントからは答えられないと伝えてください。",
    ),
    "catalogue": (
        "次の一覧は条件で絞り込んだ全件です。一覧にある事実だけを使い、型番と数値を文に織り込んで答えてください。一覧の行をそのまま写さないでください。",
        "条件に合う製品はありませんでした。推測せず、該当なしと伝えてください。",
    ),
    "code": (
        "次の資料をもとに、依頼されたソースコードだけを返してください。資料にないことは書かず、説明やコードフェンスは付けないでください。",
        "根拠になる資料はありませんでした。依頼の範囲だけでソースコードを返してください。",
    ),
}


def within_budget(hits: DataFrame, limit: int = MOST_EVIDENCE) -> DataFrame:
    """hits (query_id, position, citation, text) with ``used``, the characters of a query's evidence up to each, cut where they exceed the limit.

    A hit counts with its citation, its text and the signs that ``evidence_prompt`` puts around them, so a prompt stays within the limit.
    """
    order = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(F.coalesce("citation", F.lit(""))) + F.length(F.coalesce("text", F.lit(""))) + F.length(F.col("position").cast("string")) + 6
    return hits.withColumn("used", F.sum(size.cast("long")).over(order)).where(F.col("used") <= limit)


def prompts(questions: DataFrame, hits: DataFrame, limit: int = MOST_EVIDENCE) -> DataFrame:
    """(query_id, prompt, n_evidence) of questions (query_id, kind, text) and their hits; kinds are those of KINDS, others raise.

    A query's evidence is bounded by the limit, so gathering it is.
    """
    kept = within_budget(hits, limit).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "citation", "text"))).alias("hits"))
    rows = questions.join(kept, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kept.schema["hits"].dataType)))
    prompt = F.raise_error(F.concat(F.lit("unknown kind "), F.col("kind"))).cast("string")
    for kind, (intro, nothing) in KINDS.items():
        prompt = F.when(F.col("kind") == kind, evidence_prompt(F.col("text"), F.col("hits"), intro, nothing)).otherwise(prompt)
    return rows.select("query_id", prompt.alias("prompt"), F.size("hits").alias("n_evidence"))


#: Suffix -> (language, comment opening, comment end) of code that is written with a header of references (fixed values).
LANGUAGES = {".py": ("Python", "# ", ""), ".sh": ("シェルスクリプト", "# ", ""), ".js": ("JavaScript", "// ", ""), ".ts": ("TypeScript", "// ", ""), ".java": ("Java", "// ", ""), ".cs": ("C#", "// ", ""), ".go": ("Go", "// ", ""), ".sql": ("SQL", "-- ", ""), ".css": ("CSS", "/* ", " */"), ".html": ("HTML", "<!-- ", " -->")}


def with_reference_header(code: Column, names: Column, suffix: Column, heading: str = "参照") -> Column:
    """Code below a comment of its language that lists the references; without any, or in an unknown language, the code alone."""

    def entry(opening: str, end: str):
        return lambda name: F.concat(F.lit(f"{opening}- "), name, F.lit(end))

    out = code
    for ending, (_, opening, end) in LANGUAGES.items():
        lines = F.concat(F.array(F.lit(f"{opening}{heading}{end}")), F.transform(names, entry(opening, end)))
        out = F.when((F.lower(suffix) == ending) & (F.size(names) > 0), F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), code)).otherwise(out)
    return out


def results_markdown(hits: Column) -> Column:
    """Ordered hits (struct<citation, text>) as Markdown sections."""
    return F.concat_ws("\n\n", F.transform(hits, lambda h: F.concat(F.lit("### "), h["citation"], F.lit("\n\n"), h["text"])))


def too_long(prompt: Column, limit: int = 28_000) -> Column:
    return F.length(prompt) > limit


def reply_query(reply: Column, question: Column, limit: int = 200) -> Column:
    """The query of a JSON reply, or the question where the reply has none that is usable."""
    value = F.try_variant_get(F.try_parse_json(reply), "$.query", "string")
    plain = F.trim(F.regexp_replace(F.trim(value), "^[\"'「]+|[\"'」]+$", ""))
    return F.when((plain != "") & (F.length(plain) <= limit), plain).otherwise(question)


def page_frontmatter(title: Column, url: Column, fetched: Column) -> Column:
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("source_url: "), url), F.concat(F.lit("fetched_at: "), fetched), F.lit("---"))
