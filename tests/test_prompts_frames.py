"""Evidence within a budget, prompts of each kind, extraction with a failed flag, reference headers, frames of token streams and their limits."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import render
from quillspark.operators import catalog
from quillspark.streaming import tokens


def test_evidence_within_budget(spark):
    hits = spark.createDataFrame([(1, i, f"c{i}", "x" * 100) for i in range(1, 11)] + [(2, 1, "long", "y" * 500), (3, 1, "c", None)], "query_id int, position int, citation string, text string")
    kept = render.within_budget(hits, 330).collect()
    assert sorted((r.query_id, r.position, r.used) for r in kept) == [(1, 1, 109), (1, 2, 218), (1, 3, 327), (3, 1, 8)]
    questions = spark.createDataFrame([(1, "internal", "質問1"), (2, "docs", "質問2"), (4, "catalogue", "質問4"), (5, "code", "質問5")], "query_id int, kind string, text string")
    made = {r.query_id: r for r in render.prompts(questions, hits, 330).collect()}
    assert made[1].n_evidence == 3 and "[3] c3\n" + "x" * 100 in made[1].prompt and made[1].prompt.startswith(render.KINDS["internal"][0]) and made[1].prompt.endswith("質問: 質問1")
    assert made[2].n_evidence == 0 and render.KINDS["docs"][1] in made[2].prompt and render.KINDS["catalogue"][1] in made[4].prompt and render.KINDS["code"][1] in made[5].prompt
    assert len(made[1].prompt) <= 330 + len(render.KINDS["internal"][0]) + len("質問: 質問1") + 4
    with pytest.raises(Exception, match="unknown kind"):
        render.prompts(questions.withColumn("kind", F.lit("other")), hits).collect()


def test_reference_header(spark):
    df = spark.createDataFrame([("x = 1", ["a.md", "b.md"], ".py"), ("p {}", ["a.md"], ".css"), ("y", [], ".py"), ("z", ["a"], ".zzz")], "code string, names array<string>, suffix string")
    got = [r[0] for r in df.select(render.with_reference_header(F.col("code"), F.col("names"), F.col("suffix"))).collect()]
    assert got == ["# 参照\n# - a.md\n# - b.md\n\nx = 1", "/* 参照 */\n/* - a.md */\n\np {}", "y", "z"]


def test_extraction(spark):
    schema = {"noise": "number", "depth": "number", "tier": "string"}
    rows = [
        ("２６dB以下で奥行き510mm", '{"noise": {"lte": 26}, "depth": {"$lte": 10}}', {"noise": {"$lte": 26}}, False),
        ("高級なもの", '{"tier": {"$eq": "高級"}, "noise": {"$eq": "高級"}}', {"tier": {"$eq": "高級"}}, False),
        ("何か", "{}", {}, False), ("何か", "not json", {}, True), ("何か", "[1]", {}, True), ("何か", None, {}, True), (None, '{"noise": {"$lte": 1}}', {}, False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "question string, reply string")
    got = catalog.extracted(df, schema).collect()
    assert [(json.loads(r.conditions), r.failed) for r in got] == [r[2:] for r in rows]
    assert [(r.conditions, r.failed) for r in catalog.extracted(df, {}).collect()] == [("{}", False)] * len(rows)
    asked = [("最大の容量は", '{"x": "desc", "depth": "asc", "noise": "desc"}', ("depth", False)), ("最大の容量は", '{"noise": "up"}', (None, None)), ("容量は", '{"noise": "desc"}', (None, None)), ("一番深い", '{"tier": "desc"}', (None, None)), ("最小は", "broken", (None, None)), ("最小は", None, (None, None))]
    df = spark.createDataFrame([r[:2] for r in asked], "question string, reply string")
    assert [(r.ranking_key, r.descending) for r in catalog.extracted_ranking(df, schema).collect()] == [r[2] for r in asked]


STREAM = 'event: first\ndata: {"a":\ndata: "é"}\n\n: comment\nid: 7\n\nevent: none\n\ndata: {"type": "second", "n": 1}\r\n\r\ndata: [DONE]\n\ndata: {"type": "last"}'.encode()
EVENTS = [("first", '{"a":\n"é"}'), ("second", '{"type": "second", "n": 1}'), ("last", '{"type": "last"}')]


def test_frames_do_not_depend_on_the_cuts():
    for size in range(1, len(STREAM) + 1):
        held, event, data, out = b"", "", [], []
        pieces = [STREAM[i : i + size] for i in range(0, len(STREAM), size)]
        for i, piece in enumerate(pieces):
            found, held, event, data = tokens.feed(held, event, data, piece, i + 1 == len(pieces))
            out += found
        assert out == EVENTS, size
    for bad in (b"data: {\n\n", b'data: {"n": 1}\n\n', b"data: 3\n\n", b"data: \xff\n\n"):
        with pytest.raises(tokens.StreamError):
            tokens.feed(b"", "", [], bad, False)


def run_frames(spark, tmp_path, batches, wait=0.0, **limits):
    """Rows that a stream of batches of pieces gives, one batch after the other. Batches without data would go on for ever, as a timeout may be due."""
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "stream_id string, seq long, data binary, last boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(schema).parquet(str(folder))
    out, rows = tokens.frames(stream, **limits), []
    query = out.writeStream.foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(len(batches)):
            part = next(p for p in (tmp_path / f"b{i}").iterdir() if p.suffix == ".parquet")
            part.rename(folder / f"{i}.parquet")
            end = time.time() + 60
            while time.time() < end and (query.lastProgress is None or query.lastProgress["batchId"] < i or query.status["isDataAvailable"]) and query.exception() is None:
                time.sleep(0.3)
            time.sleep(wait)
        return sorted(rows, key=str)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_frames_stream_and_content_limit(spark, tmp_path):
    half = len(STREAM) // 2
    first = [("a", 0, STREAM[:half], False), ("big", 0, b"data: " + b"x" * 50, False), ("bad", 0, b"data: {\n\n", False)]
    second = [("a", 1, STREAM[half:], True), ("big", 1, b"y" * 300, False), ("bad", 1, b'data: {"type": "late"}\n\n', True)]
    rows = run_frames(spark, tmp_path, [first, second], most_bytes=300)
    assert [r for r in rows if r[0] == "a"] == [("a", i, n, p, None) for i, (n, p) in enumerate(EVENTS, 1)]
    assert [(r[0], r[4]) for r in rows if r[0] != "a"] == [("bad", "a frame isn't JSON"), ("big", "the stream exceeded its content limit")]
    assert (tokens.MOST_BYTES, tokens.MOST_SECONDS) == (1 << 20, 120.0)


def test_time_limit_of_a_silent_stream(spark, tmp_path):
    """The limit is a timeout of the state: it strikes in the next batch, whatever that brings."""
    batches = [[("quiet", 0, b'data: {"type": "x"}\n\ndata: ', False), ("done", 0, b'data: {"type": "y"}\n\n', True)], [("other", 0, b'data: {"type": "z"}\n\n', True)]]
    rows = run_frames(spark, tmp_path, batches, wait=2.5, most_seconds=2.0)
    assert [r for r in rows if r[0] != "quiet"] == [("done", 1, "y", '{"type": "y"}', None), ("other", 1, "z", '{"type": "z"}', None)]
    assert [r for r in rows if r[0] == "quiet"] == [("quiet", 1, "x", '{"type": "x"}', None), ("quiet", 2, None, None, "the stream exceeded its time limit")]
