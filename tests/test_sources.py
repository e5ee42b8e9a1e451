import base64
import urllib.parse
import zlib

import pytest

from quillspark.operators.store import Store, StoreError
from quillspark.sources import docs, drawio, files, html, markdown
from quillspark.streaming import ingest, strip

PAGE = """---
model_id: UD-1
washing_capacity_kg: 9.0
noise_wash_db: 27
tags: [IoT, スマホ連携]
nested:
  skip: 1
---
# 題名
まえがき
## 設置
```
## not a heading
```
幅 600
## 空

## 最後
終わり
"""


def test_markdown():
    units = markdown.units(PAGE.replace("\n", "\r\n"))
    assert [u["heading"] for u in units] == ["", "設置", "最後"] and [u["location"] for u in units] == [1, 2, 3]
    assert units[1]["text"].startswith("題名\nIoT スマホ連携\n設置\n```\n## not a heading")
    assert units[0]["attributes"] == {"model_id": "UD-1", "washing_capacity_kg": 9.0, "noise_wash_db": 27}
    assert markdown.units("---\nopen\n") and not markdown.units("")


def test_headings_and_blocks():
    text = '# A {#a}\n<span id="x"></span>\n### B {.c}\n```\n### code\n```'
    assert markdown.normalised_headings(text, 3) == "# A\n## B\n```\n### code\n```"
    assert markdown.normalised_headings("# A", demote_h1=True) == "## A"
    source = "# T\n\npara\nline\n\n- a\n- b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n```py\nx\n```"
    parts = markdown.blocks(source)
    assert [b["kind"] for b in parts] == ["heading", "paragraph", "bullets", "table", "code"]
    assert markdown.rendered(parts) == source


def test_html():
    page = "<title>題</title><style>p{}</style><p>a&nbsp;&amp; <b>b</b></p><script>var t='</p>'</script><table><tr><th>区分</th><th>日数</th></tr><tr><td>x</td><td>1</td></tr></table>"
    assert html.extract(page) == "題\na & b\n\n区分 | 日数\nx | 1"
    assert html.extract("<script>x</script>") == ""


def test_drawio():
    model = '<mxGraphModel><root><mxCell value="&lt;b&gt;low&lt;/b&gt;"><mxGeometry y="9" x="1"/></mxCell><mxCell value="top"><mxGeometry y="1" x="2"/></mxCell><object label="none"/></root></mxGraphModel>'
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = base64.b64encode(deflate.compress(urllib.parse.quote(model).encode()) + deflate.flush()).decode()
    units = drawio.units(f'<mxfile><diagram name="P">{packed}</diagram><diagram name="bad">!!</diagram><diagram name="Q">{model}</diagram></mxfile>')
    assert [u["text"] for u in units] == ["P\ntop\nlow\nnone", "Q\ntop\nlow\nnone"] and [u["location"] for u in units] == [1, 2]


def test_decoding():
    assert files.decoded("﻿あ\r\nb".encode()) == "あ\nb"
    assert files.decoded("日本".encode("cp932")) == "日本"
    with pytest.raises(ValueError, match="neither"):
        files.decoded(b"\xff\xfe\xfd\x81")


def test_ingest_folder(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text(PAGE, encoding="utf-8")
    (root / "sub/b.txt").write_text("本文はここにあります。十分に長い。", encoding="utf-8")
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfd\x81")
    (root / "~$a.md").write_text("x")
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda **k: {r.source: r.status for r in ingest.ingest_folder(spark, str(root), store, **k).collect()}
    assert run() == {"a.md": "ingested", "sub/b.txt": "ingested", "bad.txt": "failed"}
    assert ingest.verify(store).first().sound and store.revision == 1
    assert run() == {"a.md": "skipped", "sub/b.txt": "skipped", "bad.txt": "failed"} and store.revision == 1
    (root / "sub/b.txt").unlink()
    assert run(only_suffix="md")["a.md"] == "skipped" and store.occurrences().where("source = 'sub/b.txt'").count() == 1
    run()
    assert store.occurrences().where("source = 'sub/b.txt'").count() == 0 and ingest.verify(store).first().sound


ROWS = "id string, text string, source string, metadata string, embedding array<double>"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("a::1", "あ1", "a.md", "{}", [1.0, 0.0]), ("a::2", "あ2", "a.md", "{}", [2.0, 0.0]), ("b::1", "あ1", "b.md", "{}", [3.0, 0.0])]
    assert store.add(spark.createDataFrame(rows, ROWS)) == 1
    assert (store.chunks().count(), store.occurrences().count()) == (2, 3)
    with pytest.raises(StoreError):
        store.replace("a.md", spark.createDataFrame([("x", "t", "b.md", "{}", [1.0])], ROWS))
    with pytest.raises(Exception, match="length zero"):
        store.replace("a.md", spark.createDataFrame([("a::1", "t", "a.md", "{}", [0.0, 0.0])], ROWS))
    assert (store.revision, store.occurrences().count()) == (1, 3)
    assert store.replace("a.md", spark.createDataFrame([("a::1", "新", "a.md", "{}", [1.0, 0.0])], ROWS)) == 2
    assert sorted(r.text for r in store.chunks().collect()) == ["あ1", "新"]
    assert store.delete_sources(spark.createDataFrame([("none",)], "source string")) == 2
    assert store.replace("a.md", spark.createDataFrame([], ROWS)) == 3
    assert [r.text for r in store.chunks().collect()] == ["あ1"]


def test_docs_config():
    text = '[[source]]\nname = "a"\nurl = "https://x"\n[[source]]\nkind = "local"\nname = "b"\npath = "p.md"\ntitle = "t"'
    assert [s["kind"] for s in docs.load_sources(text)] == ["llms", "local"]
    for bad in ('[[source]]\nname = "a"', '[[source]]\nname = "a"\nurl = "u"\nprefixes = []', '[[source]]\nkind = "ftp"\nname = "a"'):
        with pytest.raises(ValueError):
            docs.load_sources(bad)


def test_docs_pages(spark):
    paths = spark.createDataFrame([("docs/a.md",), ("docs/b/c.md",), ("docs2/x.md",), ("docs/d.cs",)], "path string")
    assert [r.path for r in docs.selected_pages(paths, ["docs"]).collect()] == ["docs/a.md", "docs/b/c.md"]
    pages = spark.createDataFrame([("a.md", "---\nd: 2\n---\nbody"), ("b.md", "new")], "name string, text string")
    old = spark.createDataFrame([("a.md", "---\nd: 1\n---\nbody"), ("b.md", "old")], "name string, text string")
    assert [r.name for r in docs.changed_pages(pages, old).collect()] == ["b.md"]
    with pytest.raises(Exception, match="unsafe"):
        docs.changed_pages(spark.createDataFrame([("../a.md", "x")], "name string, text string"), old).collect()


def test_code_references(spark):
    code = "﻿class A {\n    // <One>\n    int x;\n    // </One>\n}\n#region Two\ny\n#endregion\n//<SnippetThree>\nz\n//</SnippetThree>"
    text = "\n".join(f':::code language="cs" source="../src/a.cs" {x}:::' for x in ('id="One"', 'id="Two"', 'id="Three"', 'range="1-1"', 'id="None"', 'range="99"')) + '\n:::code source="../../../x.cs":::'
    pages = spark.createDataFrame([("docs/p.md", text), ("docs/q.md", None)], "path string, text string")
    blobs = spark.createDataFrame([("src/a.cs", code)], "path string, content string")
    rows = {r.path: r for r in docs.resolve_code(pages, blobs).collect()}
    assert rows["docs/p.md"].unresolved == 3 and rows["docs/p.md"].text.startswith("```cs\nint x;\n```\n```cs\ny\n```\n```cs\nz\n```\n```cs\nclass A {\n```")


ANSWER = "1行目\n答え：2行目\n答えは3行目\n①検出。<br />②判定。<ul><li>③ < 確認。</li></ul>答え"
CLEAN = "1行目\n2行目\n答えは3行目\n①検出。②判定。・③ < 確認。 答え"


def test_stream_cleaning_whatever_the_cuts(spark):
    assert strip.clean([ANSWER]) == CLEAN
    for size in range(1, 12):
        assert strip.clean([ANSWER[i : i + size] for i in range(0, len(ANSWER), size)]) == CLEAN


def test_streaming_query(spark, tmp_path):
    pieces = [("s", i // 3, ANSWER[i : i + 3], i + 3 >= len(ANSWER)) for i in range(0, len(ANSWER), 3)]
    schema = "stream_id string, seq long, piece string, last boolean"
    half = len(pieces) // 2
    for n, part in enumerate((pieces[:half], pieces[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    strip.clean_stream(stream).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.sql("select text from cleaned order by seq").collect()
    assert "".join(r.text for r in rows) == CLEAN


def test_watch_folder(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("最初の文章はここにあります。", encoding="utf-8")
    store = Store(spark, f"file://{tmp_path}/store")
    ingest.watch_folder(spark, str(root), store, str(tmp_path / "cp"))
    (root / "b.txt").write_text("二番目の文章もここにあります。", encoding="utf-8")
    ingest.watch_folder(spark, str(root), store, str(tmp_path / "cp"))
    assert sorted(r.source for r in store.occurrences().collect()) == ["a.txt", "b.txt"] and store.revision == 2
