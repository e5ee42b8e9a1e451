"""Language identification by bit-sliced Bloom filters over character n-grams.

Each slot of the filter holds one bit per language, so a single lookup returns all languages that contain an n-gram: the
and of its slots' bitmasks. Every n-gram of a text is looked up; the bits are counted per language, each count is
corrected for that language's false-positive rate (its share of filled slots to the power of the number of hashes), and the
language with the largest corrected count wins.

An n-gram is held by a language if enough of its sample documents have it, and not far fewer than in the language where it
is most common; so stray foreign passages in the sample don't blur the filter. Fitting uses a bounded sample
(``DOCS_PER_LANGUAGE``); prediction reads every whole text and nothing but text.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing to learn from. Ties
go to the language first in order. Repeated rows are predicted each. Other columns stay, and the operator's own columns
replace any of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled documents that each language is learned from (expected number; larger corpora are sampled by hash).
DOCS_PER_LANGUAGE = 3_000
#: Languages at most: bits of a slot's mask.
MOST_LANGUAGES = 64
GRAM, HASHES, SLOT_BITS = 4, 2, 20
LEAST_DOCS, LEAST_SHARE = 3, 0.2
#: Documents that a language has to be learned from before texts are rejected for what it doesn't hold of them.
LEAST_LEARNED = 20
UNKNOWN = "und"
#: Characters that one pass over a batch covers, for bounded memory; a longer text is a pass of its own.
PASS = 400_000


class Model(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # a bitmask per slot
    false_rate: np.ndarray  # per language
    learned: np.ndarray  # documents that each language was learned from, about


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for anything that isn't a letter."""
    out = np.full(0x110000, 32, "u4")
    for c in range(0x32400):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts in turn, how many each text has, and which texts hold a letter.

    Runs of other characters count as one space, and each text is given a space at either end.
    """
    lengths = np.fromiter(map(len, texts), "i8", len(texts)) + 2
    starts = np.concatenate(([0], np.cumsum(lengths)))
    points = _letters()[np.frombuffer("".join([f" {x} " for x in texts]).encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = points != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of the characters between two words the first stands for all
    keep[starts[:-1]] = True
    before = np.concatenate(([0], np.cumsum(keep)))[starts]
    has = np.diff(np.concatenate(([0], np.cumsum(letter)))[starts]) > 0
    line = points[keep].astype("u8")
    sizes = np.maximum(np.diff(before) - (GRAM - 1), 0)
    if not sizes.sum():
        return np.zeros(0, "u8"), sizes, has
    h = line[: len(line) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h ^= line[i : len(line) - GRAM + 1 + i]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(line), bool)  # n-grams that begin in a text's last characters would reach into the next one
    for i in range(1, GRAM):
        inside[np.maximum(before[1:] - i, before[:-1])] = False
    return h[inside[: len(h)]], sizes, has


def _positions(grams: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(HASHES):
        yield (grams >> np.uint64(64 - SLOT_BITS - 20 * i)) & np.uint64((1 << SLOT_BITS) - 1)


def _passes(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= PASS:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(docs: DataFrame, lang: Column | str = "lang") -> Model:
    """Learn from (text, lang) of docs; rows with null text or language are left out."""
    rows = docs.select(F.col("text").alias("t"), (F.col(lang) if isinstance(lang, str) else lang).alias("l")).where("t is not null and l is not null")
    counts = sorted(rows.groupBy("l").count().orderBy("l").limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r[0] for r in counts]
    if not languages:
        return Model([], np.zeros(1 << SLOT_BITS, "u1"), np.zeros(0), np.zeros(0))
    index, share = F.lit(None).cast("int"), F.lit(1.0)
    for i, (name, n) in enumerate(counts):
        index = F.when(F.col("l") == name, F.lit(i)).otherwise(index)
        share = F.when(F.col("l") == name, F.lit(min(1.0, DOCS_PER_LANGUAGE / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < share * (1 << 30)).select("t", index.alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                which = np.asarray(batch.column("i"))
                texts = batch.column("t").to_pylist()
                for i in np.unique(which):
                    per_doc = [np.unique(_grams([texts[k]])[0]) for k in np.flatnonzero(which == i)]
                    grams, n = np.unique(np.concatenate(per_doc), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view("i8")), pa.array(np.full(len(grams), i, "i4")), pa.array(n.astype("i8"))], ["g", "i", "n"])

    seen = sample.mapInArrow(run, "g long, i int, n long")
    docs_of = [max(1.0, min(n, DOCS_PER_LANGUAGE)) for _, n in counts]
    held = seen.groupBy("g").agg(*[F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(languages))])
    most = F.greatest(*[F.col(f"c{i}") / docs_of[i] for i in range(len(languages))], F.lit(0.0)) if len(languages) > 1 else F.col("c0") / docs_of[0]
    mask = F.lit(0).cast("long")
    for i, n in enumerate(docs_of):
        least = min(LEAST_DOCS, max(1, int(n) // 10))
        bit = 1 << i if i < 63 else -(1 << 63)
        mask = mask.bitwiseOR(F.when((F.col(f"c{i}") >= least) & (F.col(f"c{i}") / n >= LEAST_SHARE * F.col("most")), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    masks = held.withColumn("most", most).select("g", mask.alias("mask")).where("mask <> 0")
    at = F.array(*[F.shiftrightunsigned("g", 64 - SLOT_BITS - 20 * i).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for i in range(HASHES)])
    filled = masks.select(F.explode(at).alias("slot"), "mask").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()  # at most a row per slot
    kind = "u1" if len(languages) <= 8 else "u4" if len(languages) <= 32 else "u8"
    slots = np.zeros(1 << SLOT_BITS, kind)
    slots[filled["slot"].to_numpy("i8")] = filled["mask"].to_numpy("i8").view("u8").astype(kind)
    fill = np.array([np.count_nonzero(slots >> kind_of(slots, i) & kind_of(slots, 1)) / len(slots) for i in range(len(languages))])
    return Model(languages, slots, fill**HASHES, np.array(docs_of))


def kind_of(slots: np.ndarray, value: int):
    return slots.dtype.type(value)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    return scores(model, texts)[:2]


def scores(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (the language's share of all languages' corrected counts) and coverage (its corrected count's share of all n-grams) of each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    grams, sizes, has = _grams(texts)
    masks = np.full(len(grams), np.iinfo(model.slots.dtype).max, model.slots.dtype)
    for at in _positions(grams):
        masks &= model.slots[at.astype("i8")]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    full = np.flatnonzero(sizes)
    count = np.zeros((len(texts), len(model.languages)))
    if len(full):
        for i in range(len(model.languages)):
            bits = (masks >> kind_of(masks, i)) & kind_of(masks, 1)
            count[full, i] = np.add.reduceat(bits, starts[full], dtype="i8")
    real = np.maximum(count - sizes[:, None] * model.false_rate, 0) / (1 - model.false_rate)
    best = real.argmax(axis=1)
    total = real.sum(axis=1)
    sure = np.where(total > 0, real[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
    covered = real[np.arange(len(texts)), best] / np.maximum(sizes, 1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, np.clip(sure, 0, 1), 0.0), np.where(has, np.clip(covered, 0, 1), 0.0)


def predict(docs: DataFrame, model: Model, coverage: str | None = None) -> DataFrame:
    """docs with lang_pred and score, and coverage under a name if one is given. The model has a fixed size: a mask per slot."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = ["lang_pred", "score", *([coverage] if coverage else [])]
    rest = docs.drop(*added)
    schema = rest.withColumns({"lang_pred": F.lit(""), **{c: F.lit(0.0) for c in added[1:]}}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            numbers: list[tuple[np.ndarray, np.ndarray]] = []
            for texts in _passes([x or "" for x in batch.column("text").to_pylist()]):
                names, *values = scores(shared.value, texts)
                found += names
                numbers.append(tuple(values))
            columns = [np.concatenate(x) for x in zip(*numbers, strict=True)] or [np.zeros(0)] * 2
            extra = [pa.array(found, pa.string()), *map(pa.array, columns[: len(added) - 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *added])

    return rest.mapInArrow(run, schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document belongs to the part that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on_rest(docs: DataFrame) -> Model:
    """The model of all documents that aren't held out."""
    return fit(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))


def keep_known(docs: DataFrame, min_coverage: float = 0.3, min_letters: int = 20) -> DataFrame:
    """docs whose language is known, with lang set to it.

    Rejected are texts without a letter, and texts of ``min_letters`` and more of whose n-grams the best language holds too
    small a part, however many languages there are. A language learned from fewer than ``LEAST_LEARNED`` documents holds
    too little even of its own texts, so none of its texts is rejected.
    """
    model = fit_on_rest(docs)
    weak = [x for x, n in zip(model.languages, model.learned, strict=True) if n < LEAST_LEARNED]
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    fits = (F.col("_coverage") >= min_coverage) | (letters < min_letters) | F.col("lang_pred").isin(weak)
    found = predict(docs, model, "_coverage").where((F.col("lang_pred") != UNKNOWN) & fits)
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)
