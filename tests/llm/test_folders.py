"""Where intermediate tables go, and that they go away."""

import os

import pytest

from quillspark.llm import common, revisits


def test_scratch_tables_are_deleted(spark):
    outer = common.shared_dir(spark)
    with common.scratch(spark) as folder:
        table = common.materialize(spark.range(5), "numbers")
        assert table.count() == 5 and folder.startswith(outer) and os.listdir(folder.removeprefix("file://"))
    assert common.shared_dir(spark) == outer and not os.path.exists(folder.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake())


def test_component_rounds_leave_nothing(spark):
    with common.scratch(spark) as folder:
        found = common.connected_components(spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long"))
        assert {r.component for r in found.collect()} == {0}
        assert len(os.listdir(folder.removeprefix("file://"))) == 1


def test_fine_slices_give_the_same_matches(spark, monkeypatch):
    rows = [(i, "http://a.org/x" if i % 3 else "http://b.org/", i * 7 % 50, "response" if i % 4 else "revisit", None, None, "d", {"A": "b"}) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    want = sorted((r.record_id, r.response_id or -1) for r in revisits.resolve(df, 1).collect())
    monkeypatch.setattr(revisits, "SLICE_ROWS", 5)
    assert sorted((r.record_id, r.response_id or -1) for r in revisits.resolve(df, 8).collect()) == want
    assert revisits.resolve(df.limit(0)).count() == 0
