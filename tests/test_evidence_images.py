"""Images with stand-in models, references, replies, citations and evidence of several corpora."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import retrieval
from quillspark.operators.store import Store
from quillspark.sources import images


def fails(_):
    raise RuntimeError("broken")


def test_image_units():
    both = images.image_parser(lambda _: "A chart.", lambda _: "words on the chart")
    assert [(u["text"], u["ocr"], u["vlm"]) for u in both(b"")] == [("［画像の説明］A chart.\n［画像の文字］words on the chart", True, True)]
    assert images.image_parser(lambda _: "装飾画像。", lambda _: "short")(b"") == []
    assert [u["text"] for u in images.image_parser(fails, lambda _: "words on the chart")(b"")] == ["［画像の文字］words on the chart"]
    with pytest.raises(ValueError, match="caption: RuntimeError: broken; ocr"):
        images.image_parser(fails, fails)(b"")


def test_pages_with_little_text_are_read_as_images():
    pages = [("x" * 40, None), ("short", b"1"), ("", b"2"), ("", None)]
    got = images.page_parser(lambda _: pages, None, lambda image: "recognised text" if image == b"1" else "")(b"")
    assert [(u["location"], u["text"], u["ocr"]) for u in got] == [(1, "x" * 40, False), (2, "［画像の文字］recognised text", True)]
    with pytest.raises(ValueError):
        images.page_parser(lambda _: [("", b"1")], fails, None)(b"")
    assert images.page_parser(lambda _: [])(b"") == []


def test_columns(spark):
    rows = spark.createDataFrame([("［画像の説明］a",), ("x［画像の文字］",), ("",)], "t string")
    t = F.col("t")
    assert [tuple(r) for r in rows.select(text.is_image_block(t), text.has_caption(t), text.has_ocr(t)).collect()] == [(True, True, False), (False, False, True), (False, False, False)]
    cases = {"img/a.png": "d/img/a.png", "./a.png?x#y": "d/a.png", "../a.png": "a.png", "../../a.png": None, "../../d/a.png": None, "http://x/a.png": None, "data:x": None, "/a.png": None, "//h/a": None, "C:\\a": None, "": None, "x/../a.png": "d/a.png", "..": None}
    got = spark.createDataFrame(list(cases.items()), "target string, want string").select("target", text.local_reference(F.lit("d/p.md"), F.col("target")).alias("got")).collect()
    assert {r.target: r.got for r in got} == cases
    replies = spark.createDataFrame([('{"a": " x ", "b": "", "c": 3, "d": "y"}',), ("```json\n{\"a\": \"z\"}\n```",), ("broken",), (None,)], "r string")
    assert [r.v for r in replies.select(text.filled_values(F.col("r"), ["a", "b", "c", "e"]).alias("v")).collect()] == [{"a": "x"}, {"a": "z"}, {}, {}]
    titles = spark.createDataFrame([("s", i, x) for i, x in enumerate(["A/b", "a b", "[]", "x" * 40, "X" * 40])], "source string, number int, title string")
    names = [r.sheet for r in text.unique_sheet_names(titles).orderBy("number").collect()]
    assert names == ["A b", "a b(2)", "Sheet", "x" * 31, "X" * 28 + "(2)"]


def test_cited_evidence(spark):
    rows = [(f"{s}{i}", "same text" if i == 0 else f"text {s} {i}", s, '{"location_type": "page", "location": 7, "ocr": false}', [1.0, float(i)]) for s in ("a", "b") for i in range(2)]
    chunks, occurrences = Store.prepared(spark.createDataFrame(rows, "id string, text string, source string, metadata string, embedding array<double>"))
    asked = spark.createDataFrame([(1, "same text", [1.0, 0.0])], "query_id int, text string, embedding array<double>")
    hits = retrieval.cited(retrieval.search(asked, chunks), chunks, occurrences)
    assert {(r.text, r.citation) for r in hits.collect()} >= {("same text", "a p.7 ほか1資料"), ("text a 1", "a p.7")}
    pasted = spark.createDataFrame([(1, 1, "pasted", "clipboard")], "query_id int, position int, text string, citation string")
    out = retrieval.evidence(manual=hits, pasted=pasted).orderBy("number").collect()
    assert [r.number for r in out] == list(range(1, hits.count() + 2)) and out[-1].kind == "pasted"
