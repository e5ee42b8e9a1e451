"""Acquisition by a fixture in place of the network: fallback, web pages, a list cut short, code references, changed pages only."""

import os

import pytest

from quillspark.sources import acquire

from . import acquire_fixture


def run(spark, tmp_path, fetcher="tests.acquire_fixture:fetch", day="2026-01-01"):
    (tmp_path / "root").mkdir(exist_ok=True)
    (tmp_path / "root/notes.md").write_text("# Notes\nWritten here.\n", encoding="utf-8")
    found = acquire.acquire(spark, acquire_fixture.SOURCES, fetcher, str(tmp_path / "out"), day, str(tmp_path / "root"))
    return {r.source: r for r in found.collect()}


def files(tmp_path):
    out = tmp_path / "out"
    return {str(p.relative_to(out)): p.read_text(encoding="utf-8") for p in out.rglob("*.md")}


def test_run_and_report(spark, tmp_path):
    report = run(spark, tmp_path)
    assert {k: r.outcome for k, r in report.items()} == {"one": "updated", "two": "updated", "three": "failed", "repo": "updated", "cut": "failed", "here": "updated"}
    assert report["two"].index_only and not report["one"].index_only
    assert "web page" in report["three"].message and "cut short" in report["cut"].message
    r = report["repo"]
    assert (r.written, r.unchanged, r.failed, r.empty, r.unresolved) == (2, 0, 1, 1, 1)
    got = files(tmp_path)
    assert sorted(got) == ["here.md", "one.md", "repo/a.md", "repo/sub-b.md", "two.md"]
    assert "title: Page A\n" in got["repo/a.md"] and "\nText here.\n```csharp\nvar two = 2;\n```\n" in got["repo/a.md"] and "{%" not in got["repo/a.md"]
    assert got["one.md"].endswith("---\n# One\nAll of it.") and not [n for n in os.listdir(tmp_path / "out") if n.startswith(".pages")]


def test_only_changed_pages_are_written(spark, tmp_path):
    run(spark, tmp_path)
    before = files(tmp_path)
    again = run(spark, tmp_path, day="2026-02-02")
    assert files(tmp_path) == before and {r.outcome for r in again.values()} == {"unchanged", "failed"} and again["repo"].unchanged == 2
    changed = run(spark, tmp_path, "tests.acquire_fixture:fetch_changed", "2026-03-03")
    assert (changed["repo"].written, changed["repo"].unchanged) == (1, 1)
    after = files(tmp_path)
    assert {k for k in after if after[k] != before[k]} == {"repo/sub-b.md"} and "2026-03-03" in after["repo/sub-b.md"]


def test_a_failed_write_leaves_the_folder(spark, tmp_path):
    spark.dataSource.register(acquire.DocumentationFiles)
    (tmp_path / "out").mkdir()
    rows = spark.createDataFrame([("fine.md", "x"), ("../evil.md", "y")], acquire.FILE_SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="unsafe"):
        rows.write.format("documentation_files").option("path", str(tmp_path / "out")).mode("append").save()
    assert files(tmp_path) == {} and not (tmp_path / "evil.md").exists()
