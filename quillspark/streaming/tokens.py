"""Token streams of model servers: JSON lines and server-sent events to pieces of text."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checked(body):
    error = F.try_variant_get(body, "$.error", "string")
    return F.when(error.isNotNull(), F.raise_error(error).cast("string"))


def json_line_pieces(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, piece, last) of lines (stream_id, seq, line): blank ones are skipped, an error object raises."""
    body = F.try_parse_json("line")
    rows = lines.where(F.trim("line") != "").withColumn("_b", body)
    piece = F.coalesce(_checked(F.col("_b")), F.try_variant_get("_b", "$.message.content", "string"), F.lit(""))
    return rows.select("stream_id", "seq", piece.alias("piece"), F.coalesce(F.try_variant_get("_b", "$.done", "boolean"), F.lit(False)).alias("last"))


def event_pieces(lines: DataFrame) -> DataFrame:
    """The same for lines of server-sent events; [DONE] ends a stream, comments and other fields are skipped."""
    data = F.trim(F.regexp_replace("line", "^data:", ""))
    rows = lines.where(F.col("line").startswith("data:")).withColumn("_d", data).withColumn("_b", F.try_parse_json("_d"))
    piece = F.coalesce(_checked(F.col("_b")), F.try_variant_get("_b", "$.choices[0].delta.content", "string"), F.lit(""))
    return rows.select("stream_id", "seq", piece.alias("piece"), (F.col("_d") == "[DONE]").alias("last"))


class StreamError(ValueError):
    """A stream that breaks its format or its limits."""


#: Bytes and seconds that one stream may take (fixed values).
MOST_BYTES, MOST_SECONDS = 1 << 20, 120.0
FRAMES = "stream_id string, number long, event string, payload string, error string"
_STATE = "held binary, event string, data array<string>, received long, started double, number long, over boolean"


def feed(held: bytes, event: str, data: list[str], piece: bytes, last: bool) -> tuple[list[tuple[str, str]], bytes, str, list[str]]:
    """Events (name, payload) that one more piece completes, and what stays open: part of a line, the event's name and its data.

    Pieces may be cut anywhere, inside a character as well. A frame ends at a blank line or with the stream; one without data is none, and
    [DONE] is no event. A frame whose data isn't a JSON object, or that has neither a name nor a type, raises.
    """
    *lines, held = (held + piece).split(b"\n")
    if last:
        lines, held = [*lines, held, b""], b""
    out = []
    for raw in lines:
        try:
            line = raw.removesuffix(b"\r").decode("utf-8")
        except UnicodeDecodeError:
            raise StreamError("a line isn't UTF-8") from None
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data = [*data, line[5:].lstrip()]
        elif not line:
            body = "\n".join(data)
            if data and body != "[DONE]":
                try:
                    payload = json.loads(body)
                except ValueError:
                    raise StreamError("a frame isn't JSON") from None
                name = event or (payload.get("type") if isinstance(payload, dict) else None)
                if not isinstance(payload, dict) or not isinstance(name, str) or not name:
                    raise StreamError("a frame has neither a name nor a type")
                out.append((name, body))
            event, data = "", []
    return out, held, event, data


def frames(chunks: DataFrame, most_bytes: int = MOST_BYTES, most_seconds: float = MOST_SECONDS) -> DataFrame:
    """(stream_id, number, event, payload, error) of raw pieces (stream_id string, seq long, data binary, last boolean), batch by batch.

    A stream that breaks its format, is longer than ``most_bytes`` or not over ``most_seconds`` after its first piece ends with
    one row that says so; what comes later is passed over. The time limit is a timeout of the stream's state, so it also holds for
    streams of which nothing comes any more.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, event, data, received, started, number, over = state.get if state.exists else (b"", "", [], 0, time.time(), 0, False)
        rows = []
        if state.hasTimedOut:
            if not over:
                rows.append((key[0], number + 1, None, None, "the stream exceeded its time limit"))
            state.remove()
        else:
            parts = pd.concat(list(batches)).sort_values("seq")
            for piece, last in zip(parts["data"], parts["last"], strict=True):
                if over:
                    break
                received += len(piece or b"")
                try:
                    if received > most_bytes:
                        raise StreamError("the stream exceeded its content limit")
                    if time.time() - started > most_seconds:
                        raise StreamError("the stream exceeded its time limit")
                    found, held, event, data = feed(bytes(held), event, list(data), bytes(piece or b""), bool(last))
                    for name, payload in found:
                        number += 1
                        rows.append((key[0], number, name, payload, None))
                    over = bool(last)
                except StreamError as error:
                    rows.append((key[0], number + 1, None, None, str(error)))
                    over = True
            state.update((bytes(held) if not over else b"", event, [] if over else list(data), received, started, number, over))
            state.setTimeoutDuration(max(1, int((started + most_seconds - time.time()) * 1000)))
        yield pd.DataFrame(rows, columns=["stream_id", "number", "event", "payload", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, FRAMES, _STATE, "append", "ProcessingTimeTimeout")
