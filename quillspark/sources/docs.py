"""Documentation sources: configuration, page selection, code references and change detection."""

from __future__ import annotations

import posixpath
import re
import textwrap
import tomllib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_frontmatter

#: Keys that each kind of source may and must have (fixed values).
KINDS = {
    "llms": ({"name", "url"}, {"kind", "version"}),
    "github": ({"name", "owner", "repo", "ref", "prefixes"}, {"kind", "version", "license"}),
    "local": ({"name", "path", "title"}, {"kind", "section_level", "demote_h1", "url", "license"}),
}
SOURCES = "name string, kind string, settings string"


def load_sources(text: str) -> list[dict[str, Any]]:
    """Sources of a TOML text ([[source]] tables); unknown kinds and keys and missing ones raise."""
    out = []
    for raw in tomllib.loads(text).get("source", []):
        kind = raw.get("kind", "llms")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        needed, allowed = KINDS[kind]
        if missing := needed - raw.keys():
            raise ValueError(f"{kind} source without {', '.join(sorted(missing))}")
        if extra := raw.keys() - needed - allowed:
            raise ValueError(f"{kind} source with {', '.join(sorted(extra))}")
        out.append({**raw, "kind": kind})
    return out


def sources_table(spark: SparkSession, text: str) -> DataFrame:
    import json

    return spark.createDataFrame([(s["name"], s["kind"], json.dumps(s, sort_keys=True)) for s in load_sources(text)], SOURCES)


def selected_pages(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """Markdown paths at or below any prefix (a folder boundary counts), sorted."""
    below = F.lit(False)
    for p in prefixes:
        below = below | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/") if p else F.lit(True)
    return paths.where(F.col("path").endswith(".md") & below).orderBy("path")


def changed_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages (name, text) whose body differs from the stored one; front matter, which holds the day of fetching, doesn't count.

    Names that leave the folder raise.
    """
    escapes = F.col("name").startswith("/") | F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:|\\")
    safe = pages.withColumn("name", F.when(escapes, F.raise_error(F.concat(F.lit("unsafe page name "), F.col("name"))).cast("string")).otherwise(F.col("name")))
    digest = lambda c: F.sha2(without_frontmatter(F.regexp_replace(c, "\r\n?", "\n")), 256)
    old = stored.select(F.col("name").alias("_name"), digest(F.col("text")).alias("_digest"))
    return safe.join(old, F.col("name") == F.col("_name"), "left").where(~digest(F.col("text")).eqNullSafe(F.col("_digest"))).drop("_name", "_digest")


_DIRECTIVE = re.compile(r"^[ \t]*:::code[ \t]+(.*?)[ \t]*:::[ \t]*$", re.MULTILINE)
_ATTRIBUTE = re.compile(r'([\w-]+)="([^"]*)"')


def snippet(code: str, attributes: dict[str, str]) -> str | None:
    """The part of a code file that a directive names: a marked region, a range of lines, or all of it."""
    code = code.removeprefix("﻿")
    if "id" in attributes:
        for name in (attributes["id"], "Snippet" + attributes["id"]):
            for start, end in ((rf"^[ \t]*//[ \t]*<{re.escape(name)}>[ \t]*$", r"^[ \t]*//[ \t]*</"), (rf"^[ \t]*#region[ \t]+{re.escape(name)}[ \t]*$", r"^[ \t]*#endregion")):
                if opened := re.search(start, code, re.MULTILINE):
                    tail = code[opened.end() :]
                    closed = re.search(end, tail, re.MULTILINE)
                    return textwrap.dedent(tail[: closed.start()] if closed else tail).strip("\n")
        return None
    if "range" in attributes:
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", attributes["range"])
        lines = code.splitlines()
        if not m or not 1 <= int(m[1]) <= min(int(m[2] or m[1]), len(lines)):
            return None
        return "\n".join(lines[int(m[1]) - 1 : int(m[2] or m[1])])
    return code.strip("\n")


def directives(page_path: str, text: str) -> Iterator[tuple[str, str | None, dict[str, str]]]:
    """(directive, target path or None, attributes) of a page; targets outside the tree are None."""
    for m in _DIRECTIVE.finditer(text):
        attributes = {k.lower(): v for k, v in _ATTRIBUTE.findall(m[1])}
        target = posixpath.normpath(posixpath.join(posixpath.dirname(page_path), attributes.get("source", "")))
        yield m[0], target if attributes.get("source") and not target.startswith(("..", "/")) else None, attributes


def filled(path: str, text: str, code: dict[str, str]) -> tuple[str, int]:
    """A page with its directives replaced by fenced snippets of code (path -> content), and how many of them stay."""
    out, lost = text, 0
    for whole, target, attributes in list(directives(path, text)):
        part = snippet(code[target], attributes) if target in code else None
        if part is None:
            lost += 1
        else:
            out = out.replace(whole, f"```{attributes.get('language', 'csharp')}\n{part}\n```", 1)
    return out, lost


def resolve_code(pages: DataFrame, blobs: DataFrame) -> DataFrame:
    """pages (path, text) with directives replaced by fenced snippets of blobs (path, content), and unresolved (int).

    Directives are exploded and joined with the files they name, so a page meets only its own files.
    """

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(p, t) for p, x in zip(b["path"], b["text"], strict=True) for _, t, _ in directives(p, x or "") if t}
            yield pd.DataFrame(sorted(rows), columns=["page", "target"])

    wanted = pages.select("path", "text").mapInPandas(named, "page string, target string")
    files = wanted.join(blobs, wanted["target"] == blobs["path"]).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("target", "content"))).alias("files"))
    rows = pages.join(files, pages["path"] == files["page"], "left").drop("page")
    schema = pages.withColumn("unresolved", F.lit(0)).schema

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [filled(path, text or "", dict(code or {})) for path, text, code in zip(b["path"], b["text"], b["files"], strict=True)]
            texts, missing = [x for x, _ in made], [n for _, n in made]
            yield b.assign(text=texts, unresolved=missing)[schema.names]

    return rows.mapInPandas(fill, schema)


def fetch_report(pages: DataFrame) -> DataFrame:
    """Counts per source over (source, status, unresolved)."""
    return pages.groupBy("source").agg(
        F.count_if(F.col("status") == "written").alias("written"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.sum("unresolved").alias("unresolved"),
    )


def rendered_page(title: Column, url: Column, fetched: Column, body: Column) -> Column:
    from ..functions.render import page_frontmatter

    return F.concat(page_frontmatter(title, url, fetched), F.lit("\n\n"), body)
