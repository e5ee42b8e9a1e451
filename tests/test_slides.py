"""Lines and groups of slides."""

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.sources import office


def test_only_the_slides_own_number_goes(spark):
    df = spark.createDataFrame([("98\n 3 \n2024\n© someone\n\n利用率", 3)], "t string, n int")
    assert df.select(text.slide_lines(F.col("t"), F.col("n"))).first()[0] == ["98", "2024", "利用率"]
    shape = '<p:sp xmlns:p="p" xmlns:a="a"><p:spPr><a:off x="1" y="1"/></p:spPr>{}</p:sp>'
    paragraphs = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in ("98", "3", "2024", "© x", "利用率"))
    tree = office.ElementTree.fromstring(f'<p:spTree xmlns:p="p" xmlns:a="a">{shape.format(paragraphs)}</p:spTree>')
    assert [t for _, t in office._blocks(tree, 3)] == ["98\n2024\n利用率"]


def test_line_ends_do_not_count(spark):
    a, b, c, long = "a" * 100, "b" * 100, "c", "d" * 500
    for blocks, want in [([a, b], [f"{a}\n{b}"]), ([a, b, c], [f"{a}\n{b}", c]), ([long, a], [long, a]), ([], []), ([c, c], ["c\nc"])]:
        assert office.grouped(blocks) == want
        df = spark.createDataFrame([(blocks,)], "b array<string>")
        assert df.select(text.greedy_groups(F.col("b"))).first()[0] == want
