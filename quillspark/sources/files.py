"""Folders of documents to units: scan, hash, decode and parse by suffix."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CAPTION_MARK, LEAST_OCR, NO_CONTENT, OCR_MARK, file_digest
from . import drawio, html, markdown, office

#: Source-code and configuration suffixes that are read as plain text (fixed values).
TEXT_SUFFIXES = (".txt", ".py", ".js", ".ts", ".java", ".cs", ".go", ".rs", ".c", ".cpp", ".h", ".sh", ".ps1", ".json", ".yaml", ".yml", ".toml")
UNITS = "source string, file_hash string, unit_seq int, text string, location_type string, location int, ocr boolean, vlm boolean, heading string, attributes string, error string, warnings array<string>"

Parser = Callable[[bytes], list[dict[str, Any]]]


def decoded(content: bytes) -> str:
    """UTF-8 (with or without a mark) or else CP932, line ends as \\n; anything else raises."""
    for encoding in ("utf-8-sig", "cp932"):
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor CP932")


def _whole(text: str) -> list[dict[str, Any]]:
    body = text.strip()
    return [{"text": body, "location_type": "document", "location": 0, "heading": "", "attributes": {}}] if body else []


PARSERS: dict[str, Parser] = {
    **dict.fromkeys(TEXT_SUFFIXES, lambda b: _whole(decoded(b))),
    ".md": lambda b: markdown.units(decoded(b)),
    ".html": lambda b: _whole(html.extract(decoded(b))),
    ".htm": lambda b: _whole(html.extract(decoded(b))),
    ".drawio": lambda b: drawio.units(decoded(b)),
    ".docx": office.docx_units,
    ".pptx": office.pptx_units,
    ".xlsx": office.xlsx_units,
    ".xlsm": office.xlsx_units,
}


def source_key(root: str) -> Column:
    """A file's path below root."""
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    escaped = "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in base)
    return F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(f"^{escaped}/"), F.lit(""))


def scan(spark: SparkSession, root: str, only_suffix: str | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(source, file_hash, suffix, content) of the supported files below root, office lock files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = supported(files, root, parsers or PARSERS)
    return found.where(F.col("suffix") == f".{only_suffix.lower().removeprefix('.')}") if only_suffix else found


def supported(files: DataFrame, root: str, parsers: dict[str, Parser]) -> DataFrame:
    """(source, file_hash, suffix, content) of those files (path, content) that a parser takes, office lock files left out."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.where(suffix.isin(sorted(parsers)) & ~name.startswith("~$"))
    return kept.select(source_key(root).alias("source"), file_digest(F.col("content")).alias("file_hash"), suffix.alias("suffix"), "content")


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Units of each file; one that can't be read gives a single row with its error and no text, and so does one without content, without an error.

    A unit's ``warnings`` say what was left out on the way (a page, an image), so they need no second pass over the files.
    """
    table = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in UNITS.split(", ")]
        for batch in batches:
            rows = []
            for source, digest, suffix, content in zip(batch["source"], batch["file_hash"], batch["suffix"], batch["content"], strict=True):
                try:
                    if suffix not in table:
                        raise ValueError(f"unsupported format {suffix}")
                    units = table[suffix](bytes(content))
                    for i, u in enumerate(units):
                        own = (u["text"], u["location_type"], u["location"], u.get("ocr", False), u.get("vlm", False), u["heading"], json.dumps(u["attributes"], ensure_ascii=False))
                        rows.append((source, digest, i, *own, None, u.get("warnings", [])))
                    if not units:
                        rows.append((source, digest, *[None] * 9, []))
                except Exception as error:  # a bad file must not stop the others
                    rows.append((source, digest, *[None] * 8, f"{type(error).__name__}: {error}", []))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("source", "file_hash", "suffix", "content").mapInPandas(run, UNITS)


def changed(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files whose hash differs from the stored one (source, file_hash)."""
    return files if force else files.join(stored, ["source", "file_hash"], "left_anti")


def image_block(caption: Column, ocr: Column, least_ocr: int = LEAST_OCR) -> Column:
    """Caption and recognised text of an image as one block; decorations and scraps are dropped."""
    said = F.when(F.regexp_replace(F.trim(caption), "[。.]+$", "") != NO_CONTENT, F.trim(caption))
    read = F.when(F.length(F.trim(ocr)) >= least_ocr, F.trim(ocr))
    return F.when(said.isNotNull() | read.isNotNull(), F.concat_ws("\n", F.when(said.isNotNull(), F.concat(F.lit(CAPTION_MARK), said)), F.when(read.isNotNull(), F.concat(F.lit(OCR_MARK), read))))
