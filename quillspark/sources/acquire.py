"""Acquisition of documentation: configured sources to pages, and changed pages to files, as a batch data source and a sink.

``documentation_pages`` reads the sources of a TOML text (docs.load_sources). Each source of one file is a partition, and each run of
``PAGES`` pages of a repository; a source that can't be listed is a row with its error and doesn't stop the others. Fetching is handed
in by name ("package.module:function"), as a function of a URL that gives (status, content type, text); this library
opens no connection itself. ``documentation_files`` writes (name, text) rows below a folder: tasks write under temporary
names, and the commit step on the driver puts the files in their places, so a failed job leaves the folder as it was.

    fetched = acquire.fetched(spark, toml, "my.module:fetch")
    report = acquire.acquire(spark, toml, "my.module:fetch", folder, "2026-01-31")
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.render import page_frontmatter
from ..functions.text import common_folder, local_path, strip_liquid, title_of, without_frontmatter
from ..operators.tables import materialize
from . import docs

#: Pages that one partition fetches.
PAGES = 50
PAGE_SCHEMA = "source string, kind string, path string, url string, text string, status string, message string, index_only boolean, commit string, unresolved int"
FILE_SCHEMA = "name string, text string"

Fetch = Callable[[str], tuple[int, str, str]]


class NotDocumentation(ValueError):
    """What was fetched isn't what was asked for."""


def handed_in(name: str) -> Fetch:
    """The function that "package.module:function" names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def looks_like_html(content_type: str, text: str) -> bool:
    """As functions.text.looks_like_html, for use inside tasks."""
    return "text/html" in content_type.lower() or text.lstrip()[:200].lower().startswith(("<!doctype html", "<html", "<?xml"))


def body_of(fetch: Fetch, url: str) -> str:
    """The text at a URL; an error status or a web page raises."""
    status, content_type, text = fetch(url)
    if status >= 400:
        raise NotDocumentation(f"status {status} of {url}")
    if looks_like_html(content_type, text):
        raise NotDocumentation(f"{url} is a web page")
    return text


def whole_text(fetch: Fetch, url: str) -> tuple[str, bool]:
    """The text of a source of one file, and whether only its index was there: a missing llms-full.txt falls back on llms.txt."""
    status, *_ = answer = fetch(url)
    index = url.replace("llms-full.txt", "llms.txt")
    if status >= 400 and index != url:
        return body_of(fetch, index), True
    return body_of(lambda _: answer, url), False


def tree_of(fetch: Fetch, source: dict[str, Any]) -> tuple[str, list[str]]:
    """(commit, paths of files) of a repository; a list that was cut short raises, for nobody knows what it lacks."""
    tree = json.loads(body_of(fetch, f"https://api.github.com/repos/{source['owner']}/{source['repo']}/git/trees/{source['ref']}?recursive=1"))
    if tree.get("truncated"):
        raise NotDocumentation(f"the list of {source['owner']}/{source['repo']} is cut short")
    return tree.get("sha", ""), sorted(x["path"] for x in tree.get("tree", []) if x.get("type") == "blob")


def raw_url(source: dict[str, Any], path: str) -> str:
    return f"https://raw.githubusercontent.com/{source['owner']}/{source['repo']}/{source['ref']}/{path}"


def is_page(path: str, prefixes: list[str]) -> bool:
    """Whether a path is a Markdown page at or below any prefix."""
    return path.endswith(".md") and any(p == "" or path == p or path.startswith(p.rstrip("/") + "/") for p in prefixes)


class Part(InputPartition):
    def __init__(self, source: dict[str, Any], paths: list[str] | None = None, files: list[str] | None = None, commit: str = "", error: str = ""):
        self.source, self.paths, self.files, self.commit, self.error = source, paths or [], files or [], commit, error


class PageReader(DataSourceReader):
    def __init__(self, toml: str, fetcher: str, root: str):
        self.toml, self.fetcher, self.root = toml, fetcher, root

    def partitions(self) -> list[Part]:
        fetch, out = handed_in(self.fetcher), []
        for source in docs.load_sources(self.toml):
            if source["kind"] != "github":
                out.append(Part(source))
                continue
            try:
                commit, files = tree_of(fetch, source)
            except Exception as error:  # this source fails, the others go on
                out.append(Part(source, error=f"{type(error).__name__}: {error}"))
                continue
            pages = [p for p in files if is_page(p, source["prefixes"])]
            out += [Part(source, pages[at : at + PAGES], files, commit) for at in range(0, len(pages), PAGES)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        source, fetch = part.source, handed_in(self.fetcher)
        name, kind = source["name"], source["kind"]
        if part.error:
            yield name, kind, None, None, None, "source_failed", part.error, False, "", 0
        elif kind == "github":
            known = set(part.files)
            for path in part.paths:
                url = raw_url(source, path)
                try:
                    text, lost = self._with_code(fetch, source, path, body_of(fetch, url), known)
                    yield name, kind, path, url, text, "fetched", "", False, part.commit, lost
                except Exception as error:  # this page fails, the others go on
                    yield name, kind, path, url, None, "failed", f"{type(error).__name__}: {error}", False, part.commit, 0
        else:
            url, index_only = source.get("url", source.get("path", "")), False
            try:
                if kind == "llms":
                    text, index_only = whole_text(fetch, url)
                else:
                    system, base = pafs.FileSystem.from_uri(self.root)
                    with system.open_input_stream(f"{base.rstrip('/')}/{source['path']}") as f:
                        text = f.read().decode("utf-8-sig").replace("\r\n", "\n")
                yield name, kind, f"{name}.md", url, text, "fetched", "", index_only, "", 0
            except Exception as error:
                yield name, kind, None, url, None, "source_failed", f"{type(error).__name__}: {error}", False, "", 0

    @staticmethod
    def _with_code(fetch: Fetch, source: dict[str, Any], path: str, text: str, known: set[str]) -> tuple[str, int]:
        """A page with the code that it refers to, and how many references stay."""
        code: dict[str, str] = {}
        for _, target, _ in docs.directives(path, text):
            if target in known and target not in code:
                try:
                    code[target] = fetch(raw_url(source, target))[2]
                except Exception:  # it stays a reference, which is counted
                    continue
        return docs.filled(path, text, code)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.mark = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, base = pafs.FileSystem.from_uri(self.folder)
        names = []
        for row in rows:
            if row["name"].startswith("/") or "\\" in row["name"] or ".." in row["name"].split("/"):
                raise ValueError(f"unsafe page name {row['name']}")
            path = f"{base}/.pages-{self.mark}/{row['name']}"
            system.create_dir(path.rpartition("/")[0])
            with system.open_output_stream(path) as f:
                f.write(row["text"].encode("utf-8"))
            names.append(row["name"])
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.folder)
        for name in (n for m in messages if m for n in m.names):
            system.create_dir(f"{base}/{name}".rpartition("/")[0])
            system.move(f"{base}/.pages-{self.mark}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.folder)
        if system.get_file_info(f"{base}/.pages-{self.mark}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{base}/.pages-{self.mark}")


class DocumentationPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documentation_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["sources"], self.options["fetcher"], self.options.get("root", "."))


class DocumentationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documentation_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def fetched(spark: SparkSession, toml: str, fetcher: str, root: str = ".") -> DataFrame:
    """The pages of all sources, fetched when read."""
    spark.dataSource.register(DocumentationPages)
    return spark.read.format("documentation_pages").option("sources", toml).option("fetcher", fetcher).option("root", root).load()


def rendered(pages: DataFrame, fetched_at: str) -> DataFrame:
    """pages with name (where the page goes), body and text (front matter and body); pages without a body get the status empty."""
    got = pages.where(F.col("kind") == "github").groupBy("source").agg(common_folder(F.min("path"), F.max("path")).alias("_prefix"))
    rows = pages.join(got, "source", "left")
    name = F.when(F.col("kind") == "github", F.concat("source", F.lit("/"), local_path(F.col("path"), F.col("_prefix")))).otherwise(F.col("path"))
    plain = F.when(F.col("kind") == "github", strip_liquid(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("name", name).withColumn("_plain", plain).withColumn("body", without_frontmatter(F.col("_plain")))
    status = F.when((F.col("status") == "fetched") & F.col("body").rlike(r"\A\s*\z"), "empty").otherwise(F.col("status"))
    text = F.concat(page_frontmatter(title_of(F.col("_plain"), F.col("path")), F.coalesce("url", F.lit("")), F.lit(fetched_at)), F.lit("\n"), F.col("body"))
    return rows.withColumns({"status": status, "text": F.when(F.col("text").isNotNull(), text)}).drop("_prefix", "_plain")


def acquire(spark: SparkSession, toml: str, fetcher: str, folder: str, fetched_at: str, root: str = ".") -> DataFrame:
    """Fetch all sources, write the pages whose body changed below folder, and report.

    A row per source: pages written, unchanged, failed, empty and unresolved references, whether only an index was there, the message of a
    source that failed, and outcome: updated, unchanged or failed. Each page is fetched once.
    """
    spark.dataSource.register(DocumentationFiles)
    pages = materialize(rendered(fetched(spark, toml, fetcher, root), fetched_at), "pages")
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    stored = files.select(docs_key(folder).alias("name"), F.col("content").cast("string").alias("text"))
    able = pages.where("status = 'fetched'")
    changed = materialize(docs.changed_pages(able.select("source", "name", "text"), stored), "changed-pages")
    changed.select("name", "text").coalesce(8).write.format("documentation_files").option("path", folder).mode("append").save()
    marked = pages.join(changed.select("source", "name", F.lit(True).alias("_new")), ["source", "name"], "left")
    status = F.when(F.col("status") != "fetched", F.col("status")).when(F.col("_new"), "written").otherwise("unchanged")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = marked.withColumn("status", status).groupBy("source").agg(
        *map(n, ("written", "unchanged", "failed", "empty")), F.sum("unresolved").cast("long").alias("unresolved"), F.bool_or("index_only").alias("index_only"), F.max(F.when(F.col("status") == "source_failed", F.col("message"))).alias("message")
    )
    outcome = F.when(F.col("message").isNotNull(), "failed").when(F.col("written") > 0, "updated").otherwise("unchanged")
    return counts.withColumn("outcome", outcome)


def docs_key(folder: str):
    """A file's name below folder."""
    from .files import source_key

    return source_key(folder)
