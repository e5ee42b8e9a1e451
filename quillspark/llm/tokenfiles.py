"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

One row per document, in ascending doc_id order, in files that each hold a range of ids and many stripes: the writer looks at
its memory every ``CHECKED`` rows and ends a stripe at about ``STRIPE`` bytes. A reader that wants some documents prunes files and
stripes by their statistics, and within a stripe groups of ``STRIDE`` rows by theirs and by Bloom filters; one that wants all of
them reads stripes in parallel: Spark cuts files into splits, and a split reads the stripes that begin in it. ``start``, the number of ids before a document, is stored beside its ids, so a
reader can go to a place in the token stream without reading what comes before it.

Null texts are the empty text; each document ends with the end id, so an empty one holds that alone. Rows with equal
doc_id are kept and stand side by side, the null doc_id first. Other columns aren't stored.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import PieceCache, pieces

#: Bytes of a stripe in memory, rows after which the writer compares, and rows of an index entry (ORC's least is 1,000).
STRIPE, CHECKED, STRIDE = 1 << 20, 250, 1_000
#: ORC writer settings: many stripes, an index entry for each group of rows, Bloom filters on the ids.
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": str(STRIDE),
    "orc.stripe.size": str(STRIPE),
    "orc.rows.between.memory.checks": str(CHECKED),
    "compression": "snappy",
}

#: Distinct chunks that a worker remembers, at some 200 bytes each.
MOST_CHUNKS = 1_600_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's encoder, giving little-endian 32-bit ids, and a cache of chunks over it; one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in tool.encode_batch_fast(texts, add_special_tokens=False)]

    return encode, PieceCache(_words_first(tool, encode), MOST_CHUNKS)


def _words_first(tool, encode):
    """encode, but a lone word, which is one piece for the pre-tokenizer, goes straight to the library's BPE model.

    The model takes bytes as the letters that byte-level BPE writes them with.
    """
    from tokenizers import pre_tokenizers

    model, split = tool.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {c: split.pre_tokenize_str(chr(c))[0][0] for c in range(32, 0x250) if chr(c).isalpha() or c == 32}

    def run(texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        rest = []
        for x in texts:
            word = x[1:] if x[:1] == " " else x
            if word.isalpha() and max(word) < "\u0250":
                out.append(array("i", [t.id for t in model.tokenize(x.translate(letters))]).tobytes())
            else:
                out.append(None)
                rest.append(x)
        found = iter(encode(rest) if rest else ())
        return [next(found) if x is None else x for x in out]

    return run


def encode(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(doc_id, place, before, n_tokens, tokens): rows keep their order; before counts the ids of earlier rows in the partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, cache = _tokenizer(tokenizer_file)
        end, before = np.int32(end_id).tobytes(), 0
        for big in batches:
            for at in range(0, big.num_rows, 1_000):  # ids take several times the room of the text
                batch = big.slice(at, 1_000)
                raw = []
                for x in batch.column("text").to_pylist():
                    chunks = pieces(x or "")
                    raw.append((whole([x or ""])[0] if chunks is None else b"".join(cache.parts(chunks))) + end)
                counts = np.fromiter(map(len, raw), "i8", len(raw)) >> 2
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype("i4")), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(before + ends - counts), pa.array(counts), tokens], ["doc_id", "place", "before", "n_tokens", "tokens"])
                before += int(ends[-1]) if len(ends) else 0

    rows = docs.select("doc_id", F.spark_partition_id().alias("place"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, place int, before long, n_tokens long, tokens array<int>")


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, docs_per_file: int = 5_000) -> None:
    """Write ``path``/ids, a file for each range of doc_id, and ``path``/places, where each file's ids begin.

    The text is shuffled once, to its range; ids are made there, in order, and written straight away, so only the files
    hold them. A stage that has to run again writes the same files.
    """
    spark, n = docs.sparkSession, docs.count()
    ranges = docs.select("doc_id", "text").repartitionByRange(max(1, -(-n // docs_per_file)), "doc_id").sortWithinPartitions("doc_id", "text")
    encode(ranges, tokenizer_file, end_id).write.options(**ORC).orc(f"{path}/ids")
    # One row per file meets in this window, never one per document.
    files = spark.read.orc(f"{path}/ids").groupBy("place").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    files.select("place", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).write.options(compression="snappy").orc(f"{path}/places")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of all documents; filters on doc_id prune files, stripes and row groups."""
    ids, places = spark.read.orc(f"{path}/ids"), spark.read.orc(f"{path}/places")
    return ids.join(places, "place").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "tokens")


def checksums(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the CRC-32 of each document's ids as little-endian 32-bit integers."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            ids, ends = np.asarray(tokens.values, "<i4"), np.asarray(tokens.offsets)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "tokens").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
