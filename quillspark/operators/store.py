"""A content-addressed store by revisions: texts and vectors (one row per text), and occurrences (where texts stand).

Data lies in immutable folders of Parquet files. A manifest per revision names them: one segment per source in ``occurrences`` (a folder
holds the sources that one commit wrote), and folders of texts and vectors that were new in their commit. A commit writes what it
changes, carries the rest over and publishes the next manifest under a name that may not exist yet; so readers see a whole revision, a
writer that fails changes nothing, and of two writers on one revision the second is refused (``StoreConflict``).

A text's id is its hash, so a text is written once whatever sources hold it; its vector may get later versions. The folders' number
stays bounded: beyond ``MOST_FOLDERS``, a commit takes the smaller half of them into its own. Rows that nothing names any more are
passed over when read until ``compact``; ``vacuum`` deletes what no kept revision names.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_id
from .predicate import column_value, compile_where, variant_value
from .vector import normalised

CHUNKS = "id string, text string, embedding array<double>"
TEXTS = "id string, text string"
VECTORS = "id string, embedding array<double>, seq long"
OCCURRENCES = "id string, chunk_id string, source string, metadata string"
SEGMENTED = f"{OCCURRENCES}, segment string"
SOURCES = "source string, segment string, n long"
#: What a manifest's ``schema`` has to be for this library.
SCHEMA = 2
#: Folders of a kind that a manifest names at most.
MOST_FOLDERS = 64


class StoreError(ValueError):
    """A write that the store refuses, or a store that can't be read."""


class StoreConflict(StoreError):
    """Another writer has published the revision that this one was about to."""


def orphans(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Chunks that no occurrence names."""
    return chunks.join(occurrences, chunks["id"] == occurrences["chunk_id"], "left_anti")


def dangling(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences whose chunk is missing."""
    return occurrences.join(chunks, occurrences["chunk_id"] == chunks["id"], "left_anti")


def integrity(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row (orphans, dangling)."""
    return orphans(chunks, occurrences).agg(F.count("*").alias("orphans")).crossJoin(dangling(chunks, occurrences).agg(F.count("*").alias("dangling")))


def with_occurrences(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(chunk_id, text, n, first): each text with the number of its places and the first one by source, location as text, and id.

    Both combine on the map side, so a text that stands everywhere costs no more than another. ``places`` has all of them, as rows.
    """
    where = F.get_json_object("metadata", "$.location")
    found = occurrences.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min(F.struct("source", where.alias("location"), "id", "metadata")).alias("first"))
    return chunks.select(F.col("id").alias("chunk_id"), "text").join(found, "chunk_id")


def places(hits: DataFrame, occurrences: DataFrame) -> DataFrame:
    """hits (id, ...) with a row for each place of their texts: source, location, occurrence_id and metadata."""
    where = F.get_json_object("metadata", "$.location")
    rows = occurrences.select(F.col("chunk_id").alias("id"), "source", where.alias("location"), F.col("id").alias("occurrence_id"), "metadata")
    return hits.join(rows, "id")


def get_by_ids(rows: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by id in the caller's order (ids: id, pos); unknown ones are left out."""
    out = rows.join(ids, "id").orderBy("pos")
    return out.limit(limit) if limit is not None else out


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    return old.join(new, key, "left_anti").unionByName(new)


def content(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    """How many rows a table has, and a sum over hashes of these columns, which is the same for the same rows in any order."""
    hashes = F.xxhash64(*columns).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(hashes), F.lit(0))).first()
    return n, int(total)


class Store:
    """The current revision of a store at a path, and writes that make the next one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # Files

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        path = self._at(folder) if folder else self._hadoop.Path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def _write_text(self, name: str, body: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(body.encode()))
        out.close()

    def _rename(self, name: str, to: str) -> None:
        """Rename a file to a name that may not exist yet."""
        options = self._hadoop.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.NONE
        self._hadoop.FileContext.getFileContext(self._at(to).toUri(), self._conf).rename(self._at(name), self._at(to), array)

    # Revisions

    def manifest(self) -> dict[str, Any]:
        """What the current revision consists of."""
        found = [n for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not found:
            if self._fs.exists(self._at("manifest.json")):
                raise StoreError(f"{self.path} has the layout of schema 1; store.migrate_store brings it to schema {SCHEMA}")
            return {"schema": SCHEMA, "revision": 0, "sources": None, "segments": [], "texts": [], "vectors": [], "garbage": False, "versions": False, "notes": {}}
        now = json.loads(self._text(f"manifests/{max(found)}"))
        if now.get("schema") != SCHEMA:
            raise StoreError(f"{self.path} has schema {now.get('schema')}, this library reads {SCHEMA}")
        return now

    @property
    def revision(self) -> int:
        return self.manifest()["revision"]

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def sources(self, now: dict | None = None) -> DataFrame:
        """(source, segment, n): where each source's occurrences are."""
        now = now or self.manifest()
        return self._read(SOURCES, [now["sources"]] if now["sources"] else [])

    def occurrences(self, now: dict | None = None) -> DataFrame:
        now = now or self.manifest()
        return self._segmented(now, [s["name"] for s in now["segments"]]).drop("segment")

    def _segmented(self, now: dict, names: list[str]) -> DataFrame:
        """Live occurrences in the segments named. Only segments with a source that has moved on are looked through by source."""
        whole = [s["name"] for s in now["segments"] if s["name"] in names and s["live"] == s["sources"]]
        partly = [n for n in names if n not in whole]
        out = self._read(SEGMENTED, whole)
        if partly:
            of = self.sources(now).select(F.col("source").alias("_source"), F.col("segment").alias("_segment"))
            rows = self._read(SEGMENTED, partly)
            out = out.unionByName(rows.join(of, F.col("source").eqNullSafe(F.col("_source")) & (F.col("segment") == F.col("_segment")), "left_semi"))
        return out

    def live(self, now: dict | None = None) -> DataFrame | None:
        """(id) of the texts that an occurrence names; None if all that are written are."""
        now = now or self.manifest()
        return self.occurrences(now).select(F.col("chunk_id").alias("id")).distinct() if now["garbage"] else None

    def _alive(self, rows: DataFrame, now: dict) -> DataFrame:
        alive = self.live(now)
        return rows if alive is None else rows.join(alive, "id", "left_semi")

    def texts(self, now: dict | None = None) -> DataFrame:
        """(id, text)"""
        now = now or self.manifest()
        return self._alive(self._read(TEXTS, [t["name"] for t in now["texts"]]), now)

    def vectors(self, now: dict | None = None) -> DataFrame:
        """(id, embedding)"""
        now = now or self.manifest()
        return self._alive(self._latest(now, [v["name"] for v in now["vectors"]]), now).select("id", "embedding")

    def _latest(self, now: dict, names: list[str]) -> DataFrame:
        rows = self._read(VECTORS, names)
        return rows.groupBy("id").agg(F.max(F.struct("seq", "embedding")).alias("v")).select("id", "v.embedding", "v.seq") if now["versions"] else rows

    def chunks(self, now: dict | None = None) -> DataFrame:
        """(id, text, embedding)"""
        now = now or self.manifest()
        return self.texts(now).join(self.vectors(now), "id").select("id", "text", "embedding")

    # Commits

    def _absorbed(self, folders: list[dict], size: str) -> list[str]:
        """The folders that a commit takes into its own, so that their number stays bounded: the smaller half of too many."""
        return [f["name"] for f in sorted(folders, key=lambda f: f[size])[: len(folders) // 2 + 1]] if len(folders) >= MOST_FOLDERS else []

    def _publish(self, base: dict, new: DataFrame | None, chunks: DataFrame | None, gone: DataFrame | None = None, everything: bool = False, check: Callable[[dict], None] | None = None, revision: int | None = None, note: dict[str, int] | None = None) -> int:
        """Make the revision after base: sources in ``new`` (occurrences) hold exactly these rows, those in ``gone`` none. ``note`` is kept in the manifest."""
        after, mark = revision or base["revision"] + 1, uuid.uuid4().hex
        names = {k: f"{k}-{after:012d}-{mark}" for k in ("segment", "texts", "vectors", "sources")}
        taken = {
            "segment": [s["name"] for s in base["segments"]] if everything else self._absorbed(base["segments"], "live"),
            "texts": [t["name"] for t in base["texts"]] if everything else self._absorbed(base["texts"], "rows"),
            "vectors": [v["name"] for v in base["vectors"]] if everything else self._absorbed(base["vectors"], "rows"),
        }
        try:
            now = self._written(base, after, names, taken, new, chunks, gone, everything)
            now["notes"] = base.get("notes", {}) | (note or {})
            if check:
                check(now)
            self._fs.mkdirs(self._at("manifests"))
            self._write_text(f"manifests/.{mark}", json.dumps(now))
            try:
                self._rename(f"manifests/.{mark}", f"manifests/{after:012d}.json")
            except Py4JJavaError as error:
                self._fs.delete(self._at(f"manifests/.{mark}"), False)
                raise StoreConflict(f"revision {after} has been published by another writer") from error
        except Exception:
            for name in names.values():
                self._fs.delete(self._at(name), True)
            raise
        return after

    def _written(self, base: dict, after: int, names: dict[str, str], taken: dict[str, list[str]], new: DataFrame | None, chunks: DataFrame | None, gone: DataFrame | None, everything: bool) -> dict:
        """The manifest of the next revision, whose folders are written."""
        at = {k: f"{self.path}/{v}" for k, v in names.items()}
        replaced = functools.reduce(DataFrame.unionByName, [x.select("source") for x in (new, gone) if x is not None] or [self.spark.createDataFrame([], "source string")]).distinct()
        replaced = replaced.withColumnRenamed("source", "_replaced")
        is_replaced = F.col("source").eqNullSafe(F.col("_replaced"))
        old_sources = self.sources(base)
        kept = old_sources.join(replaced, is_replaced, "left_anti")
        rows = [new.select("id", "chunk_id", "source", "metadata")] if new is not None else []
        if taken["segment"]:
            rows.append(self._segmented(base, taken["segment"]).drop("segment").join(replaced, is_replaced, "left_anti"))
        made = self.spark.createDataFrame([], SOURCES)
        if rows:
            functools.reduce(DataFrame.unionByName, rows).withColumn("segment", F.lit(names["segment"])).write.parquet(at["segment"])
            made = self._read(SEGMENTED, [names["segment"]]).groupBy("source", "segment").agg(F.count("*").alias("n"))
        kept.where(~F.col("segment").isin(taken["segment"]) if taken["segment"] else F.lit(True)).unionByName(made.select("source", "segment", "n")).write.parquet(at["sources"])
        now = dict(base, revision=after, schema=SCHEMA, sources=names["sources"])
        live = {r.segment: r.n for r in self.sources(now).groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a folder
        before = {s["name"]: s["sources"] for s in base["segments"]}
        now["segments"] = [{"name": s, "sources": before.get(s, n), "live": n} for s, n in sorted(live.items())]
        lost = any(s["name"] not in taken["segment"] and live.get(s["name"], 0) < s["live"] for s in base["segments"]) or (bool(taken["segment"]) and not old_sources.join(replaced, is_replaced, "left_semi").isEmpty())
        now["garbage"] = (base["garbage"] or lost) and not everything
        used = self.occurrences(now).select(F.col("chunk_id").alias("id")).distinct() if everything else None
        for kind, schema in (("texts", TEXTS), ("vectors", VECTORS)):
            carried = [f for f in base[kind] if f["name"] not in taken[kind]]
            parts = []
            if taken[kind]:
                old = self._read(TEXTS, taken[kind]) if kind == "texts" else self._latest(base, taken[kind])
                parts.append(old if used is None else old.join(used, "id", "left_semi"))
            if chunks is not None:
                known = self._read(TEXTS, [f["name"] for f in base["texts"]]).select("id") if kind == "texts" else self._latest(base, [f["name"] for f in base["vectors"]]).select("id", "embedding")
                fresh = chunks.select("id", "text") if kind == "texts" else chunks.select("id", "embedding", F.lit(after).cast("long").alias("seq"))
                same = ["id"] if kind == "texts" else ["id", "embedding"]
                parts.append(fresh.join(known, same, "left_anti"))
            if parts:
                functools.reduce(DataFrame.unionByName, parts).write.parquet(at[kind])
                n = self._read(schema, [names[kind]]).count()
                if kind == "vectors" and not now["versions"] and chunks is not None and base["vectors"] and n:
                    others = self._read(VECTORS, [f["name"] for f in base["vectors"]]).select("id")
                    now["versions"] = not self._read(VECTORS, [names[kind]]).where(F.col("seq") == after).join(others, "id", "left_semi").isEmpty()
                carried = carried + ([{"name": names[kind], "rows": n}] if n else [])
            now[kind] = carried
        if everything:
            now["versions"] = False
        return now

    @staticmethod
    def prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks, occurrences) of rows (id, text, source, metadata, embedding).

        Of equal ids the row with the greatest ``seq`` counts, if there is such a column, else the greatest text and metadata. ``rows`` is
        read for either table, so a caller with a model in it writes it first (``_staged``).
        """
        order = ["seq"] if "seq" in rows.columns else []
        last = F.max(F.struct(*order, "text", "metadata", "source", "embedding")).alias("r")
        one = rows.groupBy("id").agg(last).select("id", "r.text", "r.source", "r.metadata", "r.embedding").withColumn("chunk_id", text_id(F.col("text")))
        chunks = one.groupBy("chunk_id").agg(F.first("text").alias("text"), F.max_by("embedding", F.col("id")).alias("embedding"))
        return chunks.select(F.col("chunk_id").alias("id"), "text", normalised(F.col("embedding")).alias("embedding")), one.select("id", "chunk_id", "source", "metadata")

    def _staged(self, rows: DataFrame, write: Callable[[DataFrame], int]) -> int:
        """write(rows) with rows written before, so that whatever makes them (a model, say) runs once."""
        name = f"staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{name}")
            return write(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}"))
        finally:
            self._fs.delete(self._at(name), True)

    def add(self, rows: DataFrame) -> int:
        """Insert or overwrite rows by id; returns the new revision."""
        base = self.manifest()

        def write(staged: DataFrame) -> int:
            chunks, new = self.prepared(staged)
            old = self.occurrences(base)
            touched = new.select("source").union(old.join(new.select("id"), "id", "left_semi").select("source")).distinct().withColumnRenamed("source", "_touched")
            rest = old.join(touched, F.col("source").eqNullSafe(F.col("_touched")), "left_semi").join(new.select("id"), "id", "left_anti")
            return self._publish(base, rest.unionByName(new), chunks, gone=touched.withColumnRenamed("_touched", "source"))

        return self._staged(rows, write)

    def replace(self, source: str, rows: DataFrame) -> int:
        """Let a source hold exactly these rows, in one step."""

        def check(staged: DataFrame) -> None:
            if not staged.where(~F.col("source").eqNullSafe(F.lit(source))).isEmpty():
                raise StoreError(f"rows of another source than {source}")

        return self.replace_many(rows, self.spark.createDataFrame([(source,)], "source string"), check=check)

    def replace_many(self, rows: DataFrame, emptied: DataFrame | None = None, on: dict | None = None, check: Callable[[DataFrame], None] | None = None, note: dict[str, int] | None = None) -> int:
        """Let each source of rows hold exactly its rows, and each of ``emptied`` (source) none besides, in one step.

        ``on`` is the manifest that the rows were made from; if it isn't current any more, the commit is refused. ``note``, a number by
        name, stays in the manifest: a stream's last batch, say.
        """
        base = on or self.manifest()

        def write(staged: DataFrame) -> int:
            if check:
                check(staged)
            chunks, new = self.prepared(staged)
            return self._publish(base, new, chunks, gone=emptied, note=note)

        return self._staged(rows, write)

    def delete_sources(self, gone: DataFrame, on: dict | None = None) -> int:
        """Drop the sources listed; without a match nothing changes, the revision included."""
        base = on or self.manifest()
        hit = self.sources(base).join(gone.select(F.col("source").alias("_gone")).distinct(), F.col("source").eqNullSafe(F.col("_gone")), "left_semi").select("source")
        return base["revision"] if hit.isEmpty() else self._publish(base, None, None, gone=hit)

    def delete(self, where: dict[str, Any]) -> int:
        """Drop the occurrences whose source or metadata meet the conditions; without a match nothing changes. Conditions may not be empty."""
        if not where:
            raise StoreError("a delete needs conditions")
        base = self.manifest()
        rows = self.occurrences(base).withColumn("_metadata", F.try_parse_json("metadata"))
        of_metadata, of_source = variant_value("_metadata"), column_value({"source": "string"})
        gone = F.coalesce(compile_where(where, lambda key, value: of_source(key, value) if key == "source" else of_metadata(key, value)), F.lit(False))
        hit = rows.where(gone).select("source").distinct()
        if hit.isEmpty():
            return base["revision"]
        rest = rows.where(~gone).drop("_metadata").join(hit.select(F.col("source").alias("_hit")), F.col("source").eqNullSafe(F.col("_hit")), "left_semi")
        return self._publish(base, rest, None, gone=hit)

    def delete_orphans(self, known: DataFrame, protected: str = "uploads/") -> int:
        """Drop sources that are neither known nor under the protected prefix."""
        return self.delete_sources(self.sources().select("source").join(known, "source", "left_anti").where(~F.col("source").startswith(protected)))

    def compact(self) -> int:
        """A revision with the same rows in one folder of each kind, without what nothing names."""
        return self._publish(self.manifest(), None, None, everything=True)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders and manifests that none of the last ``keep`` revisions names. Folders of commits under way are later ones and stay."""
        revisions = sorted(n for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())
        kept = [json.loads(self._text(f"manifests/{n}")) for n in revisions[-keep:]]
        if not kept:
            return []
        named = {f["name"] for m in kept for k in ("segments", "texts", "vectors") for f in m[k]} | {m["sources"] for m in kept}
        last = kept[-1]["revision"]
        old = [n for n in self._names() if n.split("-")[0] in ("segment", "texts", "vectors", "sources") and n not in named and int(n.split("-")[1]) <= last]
        old += [f"{index}/{n}" for index in ("lexical",) for n in self._names(index) if n not in named]
        for name in [*old, *(f"manifests/{n}" for n in revisions[:-keep])]:
            self._fs.delete(self._at(name), True)
        return sorted(old)


def migrate(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One-table rows (id, text, source, metadata, embedding) as (chunks, occurrences); vectors must be usable."""
    return Store.prepared(old)


def _checked(store: Store, now: dict, chunks: DataFrame, occurrences: DataFrame) -> None:
    """Raise unless a written revision holds exactly these rows, and every chunk is named."""
    pairs = {
        "occurrences": (store.occurrences(now), occurrences, ["id", "chunk_id", "source", "metadata"]),
        "chunks": (store.chunks(now), chunks, ["id", "text", "embedding"]),
    }
    for name, (new, old, columns) in pairs.items():
        if content(new, columns) != content(old, columns):
            raise StoreError(f"verification failed: the {name} differ from the old ones")
    if not orphans(store.chunks(now), store.occurrences(now)).isEmpty():
        raise StoreError("verification failed: there are chunks that nothing names")


def migrate_store(spark: SparkSession, path: str, one_table: DataFrame | None = None, revision: int = 1) -> int:
    """Bring a store of schema 1 at path, or the rows of a single table, to the current schema; returns the revision, which stays the same.

    The new folders are written beside the old ones, read back and compared with them by counts and digests; only then is the manifest
    published. The old manifest stays as ``manifest.v1.json`` and its data where it was, as a backup. After a failure everything is as before.
    """
    store = Store(spark, path)
    if store._names("manifests"):
        raise StoreError(f"{path} has been migrated")
    old_manifest = store._fs.exists(store._at("manifest.json"))
    if one_table is not None:
        (chunks, occurrences), after = migrate(one_table), revision
    elif old_manifest:
        old = json.loads(store._text("manifest.json"))
        chunks, occurrences = store._read(CHUNKS, [f"{old['folder']}/chunks"]), store._read(OCCURRENCES, [f"{old['folder']}/occurrences"])
        after = old["revision"]
    else:
        raise StoreError(f"there is no store at {path}")
    base = {"schema": SCHEMA, "revision": 0, "sources": None, "segments": [], "texts": [], "vectors": [], "garbage": False, "versions": False, "notes": {}}
    made = store._publish(base, occurrences, chunks, check=lambda now: _checked(store, now, chunks, occurrences), revision=after)
    if old_manifest:
        store._rename("manifest.json", "manifest.v1.json")
    return made
