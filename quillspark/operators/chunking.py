"""Splitting units into chunks of bounded length, code blocks kept whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST, MOST_CODE = 800, 100, 10, 2_400
#: Places to split at, best first (fixed values); the last one is between any two characters.
SEPARATORS = ["\n\n", "\n", "。", "、", " ", ""]

_FENCED = re.compile(r"^```.*?^```", re.DOTALL | re.MULTILINE)
_INDENT = re.compile(r"(?: {4}|\t)")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d+[.)])[ \t]+")


def _atoms(text: str, separators: list[str]) -> Iterator[str]:
    """Parts of at most SIZE characters, each keeping the separator in front of it."""
    if len(text) <= SIZE:
        yield text
        return
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :] or [""]
    if sep == "":
        yield from (text[i : i + SIZE] for i in range(0, len(text), SIZE))
        return
    first, *rest = text.split(sep)
    for part in [first, *(sep + x for x in rest)]:
        if part:
            yield from _atoms(part, finer)


def _pieces(text: str) -> list[str]:
    """Chunks of at most SIZE characters, neighbours sharing whole parts of up to OVERLAP, short ones included."""
    if len(text) <= SIZE:
        return [text]
    parts, window, size = [], [], 0
    for atom in _atoms(text, SEPARATORS):
        if window and size + len(atom) > SIZE:
            parts.append("".join(window).strip())
            while window and (size > OVERLAP or size + len(atom) > SIZE):
                size -= len(window.pop(0))
        window.append(atom)
        size += len(atom)
    return [*parts, "".join(window).strip()]


def split_text(text: str) -> list[str]:
    """Chunks of at most SIZE characters, neighbours sharing whole parts of up to OVERLAP; too short ones are dropped."""
    return [x for x in _pieces(text) if len(x.strip()) >= LEAST]


def _indented_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of two or more indented lines after a blank line, unless what comes before is a list item."""
    at, offset, lines = [], 0, text.split("\n")
    for line in lines:
        at.append(offset)
        offset += len(line) + 1
    i = 0
    while i < len(lines):
        if not (_INDENT.match(lines[i]) and lines[i].strip()) or (i and lines[i - 1].strip()):
            i += 1
            continue
        end = i
        while end < len(lines) and (not lines[end].strip() or _INDENT.match(lines[end])):
            end += 1
        while not lines[end - 1].strip():
            end -= 1
        before = next((x for x in reversed(lines[:i]) if x.strip()), "")
        if end - i >= 2 and not _ITEM.match(before):
            yield at[i], at[end - 1] + len(lines[end - 1])
        i = end


def code_spans(text: str) -> list[tuple[int, int]]:
    """Fenced and indented code blocks, in order and without overlap."""
    fenced = [m.span() for m in _FENCED.finditer(text)]
    free = [s for s in _indented_blocks(text) if all(s[1] <= a or s[0] >= b for a, b in fenced)]
    return sorted(fenced + free)


def split_keeping_code(text: str) -> list[str]:
    """As split_text, but code blocks of at most MOST_CODE characters stay whole, and no words are lost.

    Prose that fits goes with the block after it. Whatever is too short for a chunk of its own goes in front of the next chunk, whichever
    kind that is, or to the end of the last one; a text that is too short as a whole has no chunk.
    """
    out: list[str] = []
    waiting = ""

    def emit(part: str) -> None:
        nonlocal waiting
        if not part.strip():
            return
        part, waiting = (f"{waiting}\n{part}", "") if waiting else (part, "")
        if len(part.strip()) >= LEAST:
            out.append(part)
        else:
            waiting = part.strip()

    def emit_all(prose: str) -> int:
        before = len(out)
        for part in _pieces(prose):
            emit(part)
        return len(out) - before

    at = 0
    for start, end in code_spans(text):
        new, block = emit_all(text[at:start]), text[start:end]
        at = end
        if end - start > MOST_CODE:
            emit_all(block)
        elif new and not waiting and len(out[-1]) + len(block) <= SIZE:
            emit(out.pop() + "\n\n" + block)
        else:
            emit(block)
    emit_all(text[at:])
    if waiting and out:
        out[-1] += f"\n{waiting}"
    return out


def parts_of(text: Column, keep_code: bool = False) -> Column:
    """array<string> of a text's chunks."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = split_keeping_code if keep_code else split_text
        for s in batches:
            yield s.map(lambda x: split(x) if x else [])

    return run(text)


def chunk(units: DataFrame, keep_code: bool = False) -> DataFrame:
    """Chunks of units (source, location_type, location, unit_seq, text, ...) with id and chunk_index.

    Numbers run per (source, location_type, location), also over several units there; other columns are kept.
    """
    rows = units.select("*", F.posexplode(parts_of(F.col("text"), keep_code)).alias("part_seq", "part")).drop("text").withColumnRenamed("part", "text")
    order = Window.partitionBy("source", "location_type", "location").orderBy("unit_seq", "part_seq")
    numbered = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    name = F.concat("source", F.lit("::"), "location_type", F.col("location").cast("string"), F.lit("::"), F.col("chunk_index").cast("string"))
    return numbered.withColumn("id", name).drop("unit_seq", "part_seq")
