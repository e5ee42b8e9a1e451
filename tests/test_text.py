from pyspark.sql import functions as F

from quillspark.functions import render, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_bigrams(spark):
    grams = lambda s: one(spark, text.bigrams(text.nfkc(F.lit(s))))
    assert grams("ファイン") == ["ファ", "ァイ", "イン"]
    assert grams("犬") == ["犬"]
    assert grams("UD-0900i") == grams("ｕｄ ０９００Ｉ".replace(" ", "-"))
    assert grams("一人暮らし") == grams("1人暮らし")
    assert grams("十分") != grams("10分")
    assert grams("") == []


def test_synonyms(spark):
    assert one(spark, text.expand_synonyms(F.lit("36協定とは"))) == "36協定とは 三六協定について"
    assert one(spark, text.expand_synonyms(F.lit("36協定 三六協定について"))) == "36協定 三六協定について"
    assert one(spark, text.expand_synonyms(F.lit("休暇"))) == "休暇"


def test_answer_cleaning(spark):
    assert one(spark, text.strip_label(F.lit("1行目\n答え：2行目\n答えは3行目"))) == "1行目\n2行目\n答えは3行目"
    assert one(spark, text.strip_list_tags(F.lit("①検出。<br />②判定。<ul><li>③確認。</LI></ul>"))) == "①検出。②判定。・③確認。 "


def test_mermaid(spark):
    two = "a\n```mermaid\ngraph TD\n```\n````Mermaid\nA-->B\n```` \nb"
    assert one(spark, text.mermaid_definitions(F.lit(two))) == ["graph TD", "A-->B"]
    assert one(spark, text.mermaid_definitions(F.lit("graph LR"))) == ["graph LR"]
    assert one(spark, text.mermaid_definitions(F.lit("```mermaid\n\n```"))) == []


def test_pages(spark):
    page = "---\ntitle: \"T\"\n---\n# H\nbody"
    assert one(spark, text.without_frontmatter(F.lit(page))) == "# H\nbody"
    assert one(spark, text.title_of(F.lit(page), F.lit("f"))) == "T"
    assert one(spark, text.title_of(F.lit("x\n# H \n"), F.lit("f"))) == "H"
    assert one(spark, text.title_of(F.lit("x"), F.lit("f"))) == "f"
    assert one(spark, text.strip_liquid(F.lit("a{% if\n x %}b"))) == "ab"
    assert one(spark, text.looks_like_html(F.lit("text/plain"), F.lit("  <!DOCTYPE html><p>")))
    assert not one(spark, text.looks_like_html(F.lit("text/plain"), F.lit("# <html> is a tag")))


def test_marks(spark):
    assert one(spark, text.mark_names(F.lit("{{b}} {{ a }} {{b}}"))) == ["b", "a"]
    assert one(spark, text.fill_marks(F.lit("{{a}} {{b}}"), {"a": "$1\\"})) == "$1\\ {{b}}"


def test_display_mode_and_superlative(spark):
    assert one(spark, text.display_mode(F.lit("図をMermaid記法で出力して"))) == "mermaid"
    assert one(spark, text.display_mode(F.lit("マークダウンで表示"))) == "markdown"
    assert one(spark, text.display_mode(F.lit("mermaid とは"))) is None
    assert one(spark, text.is_superlative(F.lit("最大の容量は")))


def test_packing_and_rows(spark):
    blocks = F.array(*[F.lit(x * n) for x, n in (("a", 120), ("b", 70), ("c", 30), ("d", 300))])
    assert [len(x) for x in one(spark, text.greedy_groups(blocks))] == [191, 30, 300]
    assert one(spark, text.row_text(F.array(F.lit("a"), F.lit(""), F.lit("c"), F.lit(""), F.lit(None)))) == "a |  | c"
    assert one(spark, text.slide_lines(F.lit("T\n\n© x\n12\nbody"), F.lit(12))) == ["T", "body"]


def test_sigmoid_never_overflows(spark):
    assert one(spark, text.sigmoid(F.lit(-1000.0))) == 0.0
    assert one(spark, text.sigmoid(F.lit(0.0))) == 0.5


def test_citation_and_caption(spark):
    place = lambda kind, heading, ocr=False: one(spark, render.place(F.lit("a.pdf"), F.lit(kind), F.lit(3), F.lit(heading), F.lit(ocr)))
    assert place("page", "") == "a.pdf p.3"
    assert place("slide", "", True) == "a.pdf スライド3（OCR）"
    assert place("section", "設置") == "a.pdf ＞ 設置"
    assert place("sheet", "S") == "a.pdf シート「S」"
    assert place("document", "") == "a.pdf"
    assert one(spark, render.citation(F.lit("a"), F.lit(3))) == "a ほか2資料"
    none = F.lit(None).cast("double")
    assert one(spark, render.hit_caption(F.lit("a"), none, none, none)) == "a ／ cosine距離 未計測（BM25で採用） ／ BM25 一致なし ／ Reranker 未計測"


def test_reply_query(spark):
    ask = lambda reply: one(spark, render.reply_query(F.lit(reply), F.lit("q")))
    assert ask('{"query": "「x y」"}') == "x y"
    assert ask("{broken") == "q"
    assert ask('{"query": ""}') == "q"
    assert ask('{"query": "' + "x" * 201 + '"}') == "q"


def test_paths(spark):
    df = spark.createDataFrame([("docs/a/x.md",), ("docs/a/b/y.md",), ("docs/c.md",)], "path string")
    folder = df.agg(text.common_folder(F.min("path"), F.max("path"))).first()[0]
    assert folder == "docs/"
    assert one(spark, text.common_folder(F.lit("a/b/x"), F.lit("a/b/y"))) == "a/b/" and one(spark, text.common_folder(F.lit("x"), F.lit("y/z"))) == ""
    assert sorted(r[0] for r in df.select(text.local_path(F.col("path"), F.lit(folder))).collect()) == ["a-b-y.md", "a-x.md", "c.md"]


def test_documents(spark):
    from quillspark.sources.files import image_block

    assert one(spark, text.code_body(F.lit("here:\n```py\nx = 1\n```\nend"))) == "x = 1" and one(spark, text.code_body(F.lit(" x "))) == "x"
    assert one(spark, text.sheet_name(F.lit("a/b:" + "c" * 40))) == "a b " + "c" * 27
    assert one(spark, image_block(F.lit("装飾画像。"), F.lit("short"))) is None
    assert one(spark, image_block(F.lit("棒グラフ"), F.lit("1234567890"))) == "［画像の説明］棒グラフ\n［画像の文字］1234567890"
    hits = F.array(F.struct(F.lit("a.md").alias("citation"), F.lit("t").alias("text")))
    assert one(spark, render.evidence_prompt(F.lit("q"), hits, "intro", "none")) == "intro\n\n[1] a.md\nt\n\n質問: q"
    assert one(spark, render.evidence_prompt(F.lit("q"), F.filter(hits, lambda h: F.lit(False)), "intro", "none")) == "intro\n\nnone\n\n質問: q"
    assert one(spark, render.results_markdown(hits)) == "### a.md\n\nt"
    assert one(spark, render.too_long(F.lit("x" * 28_001)))
