"""Cleaning answers while they stream in pieces.

The state of a stream is a few characters: what could still become a label or a tag. The result doesn't depend on where
the pieces were cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_LABEL = re.compile("[ \t　]*答え[ \t　]*[：:][ \t　]*")
_LABEL_START = re.compile("[ \t　]*(?:答(?:え[ \t　]*(?:[：:][ \t　]*)?)?)?")
_TAG = re.compile(r"<br\s*/?>|</?ul>|</?li>", re.IGNORECASE)
_TAG_START = re.compile(r"<(?:b(?:r\s{0,8}/?)?|/?(?:u(?:l)?|l(?:i)?)?)?", re.IGNORECASE)
MOST_HELD = 40


def _replacement(tag: str) -> str:
    return {"<li>": "・", "</li>": " "}.get(tag.lower(), "")


def push(held: str, at_start: bool, piece: str, last: bool) -> tuple[str, str, bool]:
    """(output, still held, at the start of a line) after one more piece."""
    text, out, i = held + piece, [], 0
    while i < len(text):
        if at_start:
            label = _LABEL.match(text, i)
            if label and (label.end() < len(text) or last):
                i, at_start = label.end(), False
                continue
            start = _LABEL_START.match(text, i)
            if not last and start.end() == len(text) and len(text) - i < MOST_HELD:
                break
            at_start = False
            continue
        if text[i] == "<":
            if tag := _TAG.match(text, i):
                out.append(_replacement(tag[0]))
                i = tag.end()
                continue
            start = _TAG_START.match(text, i)
            if not last and start.end() == len(text) and len(text) - i < MOST_HELD:
                break
        out.append(text[i])
        at_start = text[i] == "\n"
        i += 1
    return "".join(out), text[i:], at_start


def clean(pieces: list[str]) -> str:
    """A whole answer from its pieces."""
    held, start, out = "", True, []
    for n, piece in enumerate(pieces):
        part, held, start = push(held, start, piece, n == len(pieces) - 1)
        out.append(part)
    return "".join(out)


def clean_stream(pieces: DataFrame) -> DataFrame:
    """Cleaned pieces of a stream (stream_id string, seq long, piece string, last boolean), batch or streaming."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, start, done = state.get if state.exists else ("", True, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, piece, last in zip(rows["seq"], rows["piece"], rows["last"], strict=True):
            part, held, start = push(held, start, piece or "", bool(last))
            out.append((key[0], int(seq), part))
            done = int(seq)
        state.update((held, start, done))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return pieces.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "held string, at_start boolean, seq long", "append", "NoTimeout")
