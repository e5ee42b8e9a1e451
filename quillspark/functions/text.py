"""Text functions as Column expressions; the few that Spark has no built-in for are Arrow UDFs."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kanji digits and what they fold to (fixed values).
KANJI_DIGITS = ("〇零一二三四五六七八九", "00123456789")
#: Known spelling variants and what is appended for them (fixed values).
SYNONYMS = {"36協定": "三六協定について"}


#: Characters that NFKC leaves alone whatever stands before them: ASCII, Latin, Cyrillic, kana and common ideographs.
STABLE = "\\u0000-\\u009f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žЀ-҂Ҋ-ԯ、-〩ぁ-ゖァ-ヺー-ヾ一-鿿"


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, so texts with any other character than STABLE ones go through Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(run(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


def folded(text: Column) -> Column:
    """Lower case with kanji digits as ASCII digits."""
    return F.translate(F.lower(text), *KANJI_DIGITS)


def bigrams(text: Column) -> Column:
    """Character bigrams of each run of letters, digits and underscores; a run of one character stands for itself.

    A look-ahead takes the pair that begins at each character, so all pairs come from one pass of one expression.
    """
    w = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(folded(text), F.lit(f"(?=({w}{{1,2}}))(?:{w}(?={w})|(?<!{w}){w}(?!{w}))"), F.lit(1))


#: Marks of an image block, the caption of an image that shows nothing, and characters that recognised text has at least (fixed values).
CAPTION_MARK, OCR_MARK, NO_CONTENT, LEAST_OCR = "［画像の説明］", "［画像の文字］", "装飾画像", 10


def has_caption(text: Column) -> Column:
    return text.contains(CAPTION_MARK)


def has_ocr(text: Column) -> Column:
    return text.contains(OCR_MARK)


def is_image_block(text: Column) -> Column:
    """Whether a text is what an image was turned into."""
    return text.startswith(CAPTION_MARK) | text.startswith(OCR_MARK)


def local_reference(page: Column, target: Column) -> Column:
    """Path of a file that a page (a path below a root) refers to; null for other hosts, inline data and paths that leave the root.

    Steps up are taken one by one, as a folder can't be left and entered again.
    """
    inside = F.regexp_replace(F.regexp_replace(target, r"[?#].*$", ""), "^\\./", "")
    steps = F.filter(F.concat(F.slice(F.split(page, "/"), F.lit(1), F.size(F.split(page, "/")) - 1), F.split(inside, "/")), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    walk = F.aggregate(
        steps,
        start,
        lambda a, x: F.when(x != "..", F.struct(F.concat(a["at"], F.array(x)).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["out"] | (F.size(a["at"]) == 0)).alias("out"))
        ),
    )
    refused = target.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//|/|[\\\\])") | (inside == "")
    return F.when(~refused & ~walk["out"] & (F.size(walk["at"]) > 0), F.array_join(walk["at"], "/"))


def seconds_of(reply: Column, key: str) -> Column:
    """A duration in seconds from a model server's JSON reply, which counts nanoseconds; null where it has none."""
    return F.try_variant_get(F.try_parse_json(reply), f"$.{key}", "double") / 1e9


def filled_values(reply: Column, names: list[str]) -> Column:
    """map<string,string> of the wanted names that a JSON reply gives a text for; broken replies and blank values give none."""
    parsed = F.try_parse_json(F.regexp_replace(reply, r"(?s)\A\s*```[^\n]*\n|\n?```\s*\z", ""))
    entries = [F.struct(F.lit(n).alias("key"), F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$['{n}']", "variant")) == "STRING", F.trim(F.try_variant_get(parsed, f"$['{n}']", "string"))).alias("value")) for n in names]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.coalesce(e["value"] != "", F.lit(False))))


@functools.cache
def _folding() -> np.ndarray:
    """Code point -> its folded letter, digit or underscore; 0 for what ends a run."""
    out = np.zeros(0x110000, "u8")
    for c in range(0x110000):
        x = chr(c)
        if x == "_" or unicodedata.category(x)[0] in "LN":
            out[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    for sign, digit in zip(*KANJI_DIGITS, strict=True):
        out[ord(sign)] = ord(digit)
    return out


def counted_bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As bigrams of the NFKC form, counted, for use inside tasks (Spark can count a document's tokens only by a shuffle).

    Gives the place where each text's tokens begin, and one more; the tokens, two 21-bit code points each, the second 0 for a lone
    one; and their counts.
    """
    plain = [x if x.isascii() else unicodedata.normalize("NFKC", x) for x in texts]
    plain = [x.lower() if "İ" in x or "Σ" in x else x for x in plain]  # their lower case depends on more than the letter
    sizes = np.fromiter(map(len, plain), "i8", len(plain)) + 1
    points = _folding()[np.frombuffer("".join([f"{x} " for x in ["", *plain]]).encode("utf-32-le", "surrogatepass"), "<u4")]
    of = np.repeat(np.arange(len(plain), dtype="u8"), sizes) << np.uint64(42)
    here, after, held = points[1:], np.append(points[2:], np.uint64(0)), points[1:] > 0
    pair, lone = held & (after > 0), held & (after == 0) & (points[:-1] == 0)
    keys = np.concatenate((of[pair] | here[pair] << np.uint64(21) | after[pair], of[lone] | here[lone] << np.uint64(21)))
    keys, counts = np.unique(keys, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(plain) + 1, dtype="u8") << np.uint64(42))
    return starts, keys & np.uint64((1 << 42) - 1), counts


def bigram_text(code: int) -> str:
    """The token of a code of counted_bigrams."""
    return chr(code >> 21) + (chr(code & 0x1FFFFF) if code & 0x1FFFFF else "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_id(text: Column) -> Column:
    """Content address of a text."""
    return F.sha2(text, 256)


def file_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def expand_synonyms(query: Column, table: dict[str, str] | None = None) -> Column:
    """Append, once each, the expansions of known variants that the query holds, unless it has them already."""
    pairs = (SYNONYMS if table is None else table).items()
    more = [F.when(F.contains(query, F.lit(k)) & ~F.contains(query, F.lit(v)), F.lit(v)) for k, v in pairs]
    return F.concat_ws(" ", query, F.array_distinct(F.array_compact(F.array(*more))))


def strip_label(text: Column) -> Column:
    """Drop an answer label at the start of any line."""
    return F.regexp_replace(text, "(?m)^[ \t　]*答え[ \t　]*[：:][ \t　]*", "")


def strip_list_tags(text: Column) -> Column:
    """Drop line-break and list tags; items get a bullet before and a space after."""
    plain = F.regexp_replace(text, r"(?i)<br\s*/?>|</?ul>", "")
    return F.regexp_replace(F.regexp_replace(plain, "(?i)<li>", "・"), "(?i)</li>", " ")


def mermaid_definitions(text: Column) -> Column:
    """Bodies of mermaid fences; without any fence the whole text; blank ones are dropped."""
    fences = F.regexp_extract_all(text, F.lit(r"(?ims)^(`{3,})[ \t]*mermaid[ \t]*\n(.*?)^\1`*[ \t]*$"), F.lit(2))
    bodies = F.when(F.size(fences) > 0, fences).otherwise(F.array(text))
    return F.filter(F.transform(bodies, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")


def strip_liquid(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\{%.*?%\}", "")


def without_frontmatter(text: Column) -> Column:
    """The text after a closed block between --- lines at its start."""
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n(?:.*?\n)??---[ \t]*(?:\n|\z)", "")


def title_of(text: Column, otherwise: Column) -> Column:
    """A title key of the front matter, else the first level-one heading, else the given one."""
    front = F.regexp_extract(text, r"(?s)\A(---[ \t]*\n(?:.*?\n)??---[ \t]*)(?:\n|\z)", 1)
    key = F.regexp_extract(front, r"(?m)^title:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    heading = F.trim(F.regexp_extract(without_frontmatter(text), r"(?m)^# (.+)$", 1))
    return F.when(key != "", key).when(heading != "", heading).otherwise(otherwise)


def looks_like_html(content_type: Column, text: Column) -> Column:
    """Whether a response that should be plain text is a web page."""
    head = F.lower(F.substring(F.ltrim(F.regexp_replace(text, r"\A\s+", "")), 1, 200))
    return F.lower(content_type).contains("text/html") | head.rlike(r"^(<!doctype html|<html|<\?xml)")


def mark_names(text: Column) -> Column:
    """Distinct names of {{marks}} in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), lambda x: F.trim(x)))


def fill_marks(text: Column, values: dict[str, str]) -> Column:
    """Replace the marks that have a value; others stay. Values are taken literally."""
    for name, value in values.items():
        pattern = r"\{\{\s*\Q" + name + r"\E\s*\}\}"
        text = F.regexp_replace(text, F.lit(pattern), F.lit(value.replace("\\", "\\\\").replace("$", "\\$")))
    return text


def display_mode(question: Column) -> Column:
    """The notation that a question asks to see as such, or null."""
    wish = ".{0,8}?(?:表示|出力|見せ|示し|書い|出し)"
    ask = lambda names: question.rlike(f"(?i)(?:{names})(?:記法|形式)?{wish}")
    return F.when(ask("マーメイド|mermaid"), "mermaid").when(ask("マークダウン|markdown"), "markdown")


def is_superlative(question: Column) -> Column:
    """Whether a question asks for an extreme (fixed values)."""
    return question.rlike("最大|最小|最も|一番|いちばん|最高|最低|最長")


def slide_lines(text: Column, number: Column) -> Column:
    """Lines of a slide without blank ones, copyright lines and the slide's own number."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # with F.trim itself, the index would be what is trimmed
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("©") & (x != number.cast("string")))


def greedy_groups(blocks: Column, limit: int = 200) -> Column:
    """Pack an array of blocks, in order, into texts of at most limit characters, the line ends between them not counted; a longer block stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
    joined = lambda open_blocks: F.array_join(open_blocks, "\n")

    def step(acc: Column, block: Column) -> Column:
        fits = (F.size(acc["open"]) == 0) | (acc["size"] + F.length(block) <= limit)
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(block)).alias("open"), (acc["size"] + F.length(block)).alias("size"))
        closed = F.struct(F.concat(acc["done"], F.array(joined(acc["open"]))).alias("done"), F.array(block).alias("open"), F.length(block).alias("size"))
        return F.when(fits, grown).otherwise(closed)

    return F.aggregate(blocks, start, step, lambda a: F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(joined(a["open"])))))


def row_text(cells: Column) -> Column:
    """Cells of a row joined by bars, trailing empty ones left off."""
    last = F.aggregate(F.transform(cells, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.array_join(F.slice(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), F.lit(1), last), " | ")


def sigmoid(x: Column) -> Column:
    """Logistic function that never raises e to a positive power."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def code_body(reply: Column) -> Column:
    """The first fenced block of a reply, or the reply itself."""
    inner = F.regexp_extract(reply, r"(?s)```[^\n]*\n(.*?)\n?```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(reply))


def sheet_name(title: Column) -> Column:
    """A title as a worksheet name: forbidden signs out, 31 characters at most."""
    return F.substring(F.trim(F.regexp_replace(title, r"[\[\]:*?/\\]", " ")), 1, 31)


def unique_sheet_names(titles: DataFrame) -> DataFrame:
    """titles (source, number, title) with sheet, unlike the others of its source in any letter case, and serial.

    The second and later sheets of one name get their serial in brackets, within the 31 characters that are allowed.
    """
    base = F.when(sheet_name(F.col("title")) == "", F.lit("Sheet")).otherwise(sheet_name(F.col("title")))
    same = Window.partitionBy("source", F.lower("_base")).orderBy("number")
    rows = titles.withColumn("_base", base).withColumn("serial", F.row_number().over(same))
    tail = F.concat(F.lit("("), F.col("serial").cast("string"), F.lit(")"))
    return rows.withColumn("sheet", F.when(F.col("serial") == 1, F.col("_base")).otherwise(F.concat(F.substring("_base", F.lit(1), 31 - F.length(tail)), tail))).drop("_base")


def common_folder(low: Column, high: Column) -> Column:
    """The folders that two paths share, with a slash at the end; of the least and greatest path, those of all paths."""
    a, b = F.split(low, "/"), F.split(high, "/")
    depth = F.least(F.size(a), F.size(b)) - 1
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= depth) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    return F.when(shared > 0, F.concat(F.array_join(F.slice(a, F.lit(1), shared), "/"), F.lit("/"))).otherwise(F.lit(""))


def local_path(path: Column, prefix: Column) -> Column:
    """A page's path below the common prefix, folders joined by hyphens."""
    below = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    return F.replace(below, F.lit("/"), F.lit("-"))
