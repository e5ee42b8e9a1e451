import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.sources import office
from quillspark.streaming import tokens

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def test_docx():
    body = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>一</w:t><w:tab/><w:t>二</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert office.docx_units(packed({"word/document.xml": body}))[0]["text"] == "一\t二\ncell"
    assert office.docx_units(packed({"word/document.xml": '<w:document xmlns:w="w"/>'})) == []


def test_xlsx():
    parts = {
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S1" r:id="a"/><sheet name="empty" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="a" Type="t/worksheet" Target="worksheets/1.xml"/><Relationship Id="b" Type="t/worksheet" Target="/xl/worksheets/2.xml"/>'),
        "xl/sharedStrings.xml": "<sst><si><t>区分</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c><c r="D1"/></row><row/><row><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/2.xml": "<worksheet><sheetData/></worksheet>",
    }
    units = office.xlsx_units(packed(parts))
    assert [(u["text"], u["location"], u["heading"]) for u in units] == [("S1\n区分 |  | 2\nx | ab", 1, "S1")]


def shape(text, y, x):
    return f'<p:sp><a:off x="{x}" y="{y}"/>' + "".join(f"<a:p><a:t>{t}</a:t></a:p>" for t in text.split("\n")) + "</p:sp>"


def test_pptx():
    ns = f'xmlns:p="p" xmlns:a="a" {R}'
    slide = f'<p:sld {ns}><p:spTree>{shape("right", 300000, 9)}{shape("© me", 0, 0)}{shape("1", 0, 1)}<p:grpSp>{shape("left", 310000, 1)}</p:grpSp>{shape("題名", 0, 5)}{shape("z" * 192, 900000, 0)}</p:spTree></p:sld>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="a" Type="t/slide" Target="slides/1.xml"/>'),
        "ppt/slides/1.xml": slide,
        "ppt/slides/_rels/1.xml.rels": RELS.format('<Relationship Id="n" Type="t/notesSlide" Target="../notes/1.xml"/>'),
        "ppt/notes/1.xml": f"<p:notes {ns}><p:spTree>{shape('note', 0, 0)}</p:spTree></p:notes>",
    }
    assert [u["text"] for u in office.pptx_units(packed(parts))] == ["題名\nleft\nright", "題名\n" + "z" * 192 + "\nnote"]


def test_model_column(spark):
    load = lambda: lambda texts: [float(len(t)) for t in texts]
    df = spark.createDataFrame([("abc",), (None,), ("a",), ("",)], "t string")
    assert [r[0] for r in df.select(models.model_column(load, "double", F.col("t"), batch=2)).collect()] == [3.0, None, 1.0, 0.0]


def test_retries():
    failures = [OSError("one"), OSError("two")]

    def flaky(batch):
        if failures:
            raise failures.pop()
        return batch

    assert models.called(flaky, [1], wait=0) == [1]
    with pytest.raises(ValueError, match="answers"):
        models.called(lambda b: [], [1], attempts=2, wait=0)


def test_vector_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(models.checked_vectors(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3"):
        df.select(models.checked_vectors(F.col("v"), 3)).collect()


def test_token_streams(spark):
    lines = spark.createDataFrame([("s", 0, ""), ("s", 1, '{"message": {"content": "a"}}'), ("s", 2, '{"done": true}')], "stream_id string, seq long, line string")
    assert [tuple(r) for r in tokens.json_line_pieces(lines).orderBy("seq").collect()] == [("s", 1, "a", False), ("s", 2, "", True)]
    with pytest.raises(Exception, match="no model"):
        tokens.json_line_pieces(spark.createDataFrame([("s", 0, '{"error": "no model"}')], "stream_id string, seq long, line string")).collect()
    events = spark.createDataFrame([("s", 0, ": hi"), ("s", 1, 'data: {"choices": [{"delta": {"content": "x"}}]}'), ("s", 2, "data: [DONE]")], "stream_id string, seq long, line string")
    assert [(r.piece, r.last) for r in tokens.event_pieces(events).orderBy("seq").collect()] == [("x", False), ("", True)]
