"""Ingestion: files to units to chunks to the store, in batch, by comparing listings, or as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_digest
from ..operators import chunking, navigation
from ..operators.catalog import RESERVED
from ..operators.store import Store
from ..operators.tables import materialize
from ..operators.vector import hashed_embedding
from ..sources import files

#: Metadata that every row has.
OWN = ("source", "file_hash", "location_type", "location", "ocr", "vlm", "heading", "chunk_index")

Embed = Callable[[Column], Column]


def default_embedding(text: Column) -> Column:
    """Deterministic stand-in for an embedding model; a constant part keeps any vector from being zero."""
    return F.concat(hashed_embedding(text, 63), F.array(F.lit(0.01)))


def chunk_rows(units: DataFrame, embed: Embed = default_embedding, keep_code: bool = False) -> DataFrame:
    """Store rows of units: navigation dropped, split, numbered and embedded."""
    kept = navigation.marked(units.where(F.col("error").isNull() & F.col("text").isNotNull())).where(~F.col("dropped")).drop("is_nav", "dropped")
    chunks = chunking.chunk(kept, keep_code)
    attributes = F.coalesce(F.from_json("attributes", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = F.create_map(*[x for c in OWN for x in (F.lit(c), F.col(c).cast("variant"))])
    # The engine's own keys win over attributes of the same name; all values keep their types.
    free = F.map_filter(attributes, lambda k, _: ~k.isin(*RESERVED))
    return chunks.select("id", "text", "source", F.to_json(F.map_concat(free, own)).alias("metadata"), embed(F.col("text")).alias("embedding"))


def ingest_folder(
    spark: SparkSession,
    root: str,
    store: Store,
    only_suffix: str | None = None,
    force: bool = False,
    keep_code: bool = False,
    parsers: dict[str, files.Parser] | None = None,
    embed: Embed = default_embedding,
) -> DataFrame:
    """Bring the store in line with a folder; returns (source, status, message, units, warnings).

    Unchanged files are skipped, unreadable ones leave what is stored, and sources that are gone are deleted unless only
    one suffix was scanned. ``parsers`` are taken besides the built-in ones and before them (images and scanned pages with their
    models, say); ``embed`` is the model that makes vectors of texts. All goes into one commit, which is refused if another came between.
    """
    known = files.PARSERS | (parsers or {})
    base = store.manifest()
    found = files.scan(spark, root, only_suffix, known)
    gone = None
    if only_suffix is None:
        gone = store.sources(base).select("source").join(found.select("source"), "source", "left_anti").where(~F.col("source").startswith("uploads/"))
    return _replace(spark, store, base, found, gone, force, keep_code, known, embed)


def _replace(
    spark: SparkSession,
    store: Store,
    base: dict,
    found: DataFrame,
    gone: DataFrame | None = None,
    force: bool = False,
    keep_code: bool = False,
    parsers: dict[str, files.Parser] | None = None,
    embed: Embed = default_embedding,
    note: dict[str, int] | None = None,
) -> DataFrame:
    """Take the changed files among found into the store and the sources in gone out of it, in one commit; files that can't be read leave
    what is stored. The units are written once, so each file is parsed once and each chunk embedded once."""
    stored = store.occurrences(base).select("source", F.get_json_object("metadata", "$.file_hash").alias("file_hash")).distinct()
    fresh = files.changed(found, stored, force)
    staged = f"{store.path}/staged-{uuid.uuid4().hex}"
    try:
        files.parse(fresh, parsers).write.parquet(staged)
        units = spark.read.schema(files.UNITS).parquet(staged)
        report = _report(units, found, f"{store.path}/reports/{uuid.uuid4().hex}")
        done = report.where("status = 'ingested'").select("source")
        gone = gone if gone is not None else done.limit(0)
        emptied = done.unionByName(gone.select("source"))
        if not emptied.isEmpty():
            store.replace_many(chunk_rows(units, embed, keep_code), emptied, on=base, note=note)
    finally:
        store._fs.delete(store._hadoop.Path(staged), True)
    return report


def _report(units: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """A row per file, written: its status, the units read and what parsers and models warned of."""
    seen = units.groupBy("source").agg(F.max("error").alias("message"), F.count("text").alias("units"), F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("n"), F.max(F.array_join("warnings", "; ")).alias("warnings"))
    parsed = seen.select("source", F.when(F.col("message").isNull(), "ingested").otherwise("failed").alias("status"), F.coalesce("message", F.lit("")).alias("message"), "units", F.when(F.col("n") > 0, F.col("warnings")).otherwise("").alias("warnings"))
    skipped = found.select("source").join(seen.select("source"), "source", "left_anti")
    rest = skipped.select("source", F.lit("skipped").alias("status"), F.lit("").alias("message"), F.lit(0).cast("long").alias("units"), F.lit("").alias("warnings"))
    report = parsed.unionByName(rest)
    report.write.parquet(path)
    return found.sparkSession.read.schema(report.schema).parquet(path)


LISTING = "path string, modificationTime timestamp, length long"


def watch_folder(spark: SparkSession, root: str, store: Store, checkpoint: str, parsers: dict[str, files.Parser] | None = None, embed: Embed = default_embedding) -> None:
    """Bring the store in line with what arrived in a folder, changed or went since the last call, in one commit.

    The folder's listing (path, time, length) is a table that is compared with the one of the last call, so no list of names is on the
    driver; the files that differ are opened by a join with that difference, which only looks at files within its times and lengths.
    Their digests are then compared with the store's, so a call that is repeated changes nothing.
    """
    known = files.PARSERS | (parsers or {})
    previous = f"{checkpoint.rstrip('/')}/listings"
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = materialize(all_files.select("path", "modificationTime", "length"), "listing")
    last = _last_listing(spark, previous)
    before = spark.read.schema(LISTING).parquet(last) if last else spark.createDataFrame([], LISTING)
    fresh = materialize(listed.join(before, ["path", "modificationTime", "length"], "left_anti"), "arrived")
    removed = before.join(listed, "path", "left_anti").select(files.source_key(root).alias("source"))
    base = store.manifest()
    bounds = fresh.agg(F.min("modificationTime"), F.max("modificationTime"), F.min("length"), F.max("length")).first()
    if bounds[0] is not None or not removed.isEmpty():
        within = F.lit(False) if bounds[0] is None else F.col("modificationTime").between(*bounds[:2]) & F.col("length").between(*bounds[2:])
        content = all_files.where(within).join(fresh.select("path"), "path", "left_semi")
        _replace(spark, store, base, files.supported(content, root, known), removed, parsers=known, embed=embed)
    if bounds[0] is not None or last is None or not removed.isEmpty():
        number = int(last.rpartition("/")[2]) + 1 if last else 1
        listed.write.parquet(f"{previous}/{number:012d}")


def _last_listing(spark: SparkSession, folder: str) -> str | None:
    """The newest whole listing below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    whole = [s.getPath().getName() for s in system.listStatus(path) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return f"{folder}/{max(whole)}" if whole else None


def changes_sink(spark: SparkSession, store: Store, stream: str, parsers: dict[str, files.Parser] | None = None, embed: Embed = default_embedding) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a folder's changes: files that arrived or changed are taken in and those that went out, in one commit that notes
    the batch in the manifest, so a batch that is given again changes nothing."""
    known = files.PARSERS | (parsers or {})

    def take(batch: DataFrame, number: int) -> None:
        base = store.manifest()
        if base.get("notes", {}).get(stream, -1) >= number:
            return
        rows = materialize(batch, "changes")
        arrived = rows.where("change <> 'removed'").select(F.concat(F.lit("/"), F.col("path")).alias("path"), "content")
        removed = rows.where("change = 'removed'").select(F.col("path").alias("source"))
        _replace(spark, store, base, files.supported(arrived, "/", known), removed, parsers=known, embed=embed, note={stream: number})

    return take


def stream_folder(spark: SparkSession, root: str, store: Store, checkpoint: str, parsers: dict[str, files.Parser] | None = None, embed: Embed = default_embedding, stream: str = "folder"):
    """The query that keeps a store in line with a folder: what is there now, then it ends. Call it again, or hand its parts to a longer one."""
    from .folder import FolderChanges

    spark.dataSource.register(FolderChanges)
    changes = spark.readStream.format("folder_changes").option("root", root).option("state", f"{checkpoint.rstrip('/')}/listings").load()
    sink = changes_sink(spark, store, stream, parsers, embed)
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()


def verify(store: Store) -> DataFrame:
    """One row: occurrences, orphans, dangling, and whether the store is sound."""
    from ..operators.store import integrity

    now = store.manifest()
    n = store.occurrences(now).agg(F.count("*").alias("occurrences"))
    return n.crossJoin(integrity(store.texts(now), store.occurrences(now))).withColumn("sound", (F.col("orphans") == 0) & (F.col("dangling") == 0))
