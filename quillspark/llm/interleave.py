"""Proportional stratified interleaving of documents over shards.

Rows are put in a seeded random order within their source; the row of rank r among the n of its source gets the fractional
rank (r + 1/2) / n; all rows are sorted by it and cut into shards of equal row counts (at most one apart). Any run of the
sorted rows holds each source in its share, so every shard does. All ranks are exact and no task gets a whole source:
rows are numbered inside even slices of the hash (or of the fractional rank), after the slices' own sizes.

Null texts count as no bytes; a null source is a source of its own; repeated rows are rows like any other (ties in the
hash are broken by the text's checksum). Empty tables give no rows. Only doc_id, source and text are read, so extra
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, free_name, hash_buckets, materialize, with_prefix


def assign(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    short = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_stratum"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_h"),
    )
    rows = materialize(short, "interleave-rows")  # texts are read once
    bits = bucket_bits(rows.count())
    ranked = with_prefix(rows, ["_stratum"], hash_buckets("_h", bits), ["_h", "doc_id", "text_crc32", "size"])
    fraction = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_key_rows")).drop("_rank", "_before", "_key_rows", "_key_total")
    placed = with_prefix(fraction, [], F.floor(F.col("_f") * (1 << bits)), ["_f", "_stratum", "_h", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"(_rank * {shards}) div _key_rows")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - F.expr(f"(_shard * _key_rows + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write(docs: DataFrame, path: str, shards: int = 40, seed: int = 17) -> None:
    """Write the documents as one folder per shard, rows in slot order within each file.

    Documents meet their places in a join on doc_id, so this needs doc_id to be unique and not null. A column of docs that is
    called shard or slot is written under the name with underscores before it that is still free.
    """
    own = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    kept = docs.withColumnsRenamed({c: free_name(c.lower(), [*docs.columns, "shard", "slot"]) for c in own})
    places = assign(docs, shards, seed).select("doc_id", "shard", "slot")
    kept.join(places, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
