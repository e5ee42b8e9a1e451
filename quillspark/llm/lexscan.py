"""Ranked lexical search by one Aho-Corasick scan of the documents, without a document index.

The terms of all items make one automaton, each guarded by a blank on either side; a text, its separators turned to blanks and A-Z to
lower case, is run through it once, and what the automaton reports are the term counts of the document. Its outputs, term numbers, map
to the items that hold the term. The counts (numbers, no words) are written once, for document frequencies and lengths have to be
known before anything can be scored; texts are read once per block of items.

Items are the stated query set: they come in blocks of about ``ITEMS`` items and ``TERMS`` terms, dealt by a hash, so what is
broadcast and what a task holds does not grow with their number. Each task scores its documents in pieces of ``CELLS`` sums and
keeps the best ``top`` of every item. In a large corpus the scores that a few documents reach come first: the last one kept of an item is a
lower bound for that item's result, so tasks return only what isn't below it. Nothing is lost by that.

A term is a run of ASCII letters and digits and characters beyond ASCII, of any length; texts are scanned whole. Null and empty texts have no
terms and aren't ranked. Every row of documents is a document and every row of items an item, repeated ones and null ids included; equal scores
are ordered by doc_id, null last. Items without a term in any document, empty tables and tables without terms give no rows. Only
doc_id, text and item_id are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOP = 50
#: About so many items and terms (with repeats) are searched at once.
ITEMS, TERMS = 2_000, 200_000
#: Sums that a task holds at once, and pairs of document and item after which it keeps the best only.
CELLS, HELD = 2_000_000, 400_000
#: About so many documents give the lower bounds.
SAMPLE = 20_000
#: Bytes of UTF-8: letters in lower case, blanks for what separates terms, all beyond ASCII as it is.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_BUILT: dict[str, ahocorasick.Automaton] = {}


def folded(text: str | None) -> bytes:
    """A text's terms between blanks, with a blank at either end."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(FOLD) + b" "


def n_terms(line: bytes) -> int:
    inside = np.frombuffer(line, "u1") != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Reports the number of every word between blanks. Bytes are taken as characters, so matches are exact for any script."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(f" {word.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def built(key: str, words: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of a block, made once in each worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(words)
    return _BUILT[key]


def counted(line: bytes, found: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in a line, ascending, and how often each occurs."""
    hits = (number for _, number in found.iter(line.decode("latin-1")))
    total = np.zeros(0, "i8")
    while part := list(itertools.islice(hits, 1_000_000)):
        new = np.bincount(part, minlength=len(total))
        new[: len(total)] += total
        total = new
    which = np.flatnonzero(total)
    return which, total[which]


def term_counts(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Written (doc_id, n, terms, counts): a document's length, and the numbers and counts of the words that it holds."""
    schema = "doc_id long, n long, terms array<int>, counts array<long>"
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = built(key, shared.value) if shared.value else None
        for batch in batches:
            n, which, how = [], [], []
            for text in batch.column("text"):
                line = folded(text.as_py())
                n.append(n_terms(line))
                a, b = counted(line, found) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"))
                which.append(a.astype("i4"))
                how.append(b.astype("i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(how, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "term-counts")


def best(item: np.ndarray, score: np.ndarray, none: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores of every item, ordered; equal scores by document, ones without an id last."""
    order = np.lexsort((doc, none, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < top]


def scored(counts: DataFrame, weights: np.ndarray, starts: np.ndarray, holders: np.ndarray, items: int, n_docs: int, length: int, floor: np.ndarray, top: int) -> DataFrame:
    """(item int, doc_id, score): per task, the best documents of every item that don't score below its floor.

    ``holders[starts[t] : starts[t + 1]]`` are the items of word t.
    """
    held = counts.sparkSession.sparkContext.broadcast((weights, starts, holders, floor))
    step = max(1, CELLS // max(items, 1))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, score, no id, doc_id) of pairs that may be among the best."""
        weight, start, holder, least = held.value
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            terms, tf = batch.column("terms"), batch.column("counts").flatten().to_numpy()
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            term, row = terms.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lengths)
            if not len(term):
                continue
            m = 100 - 50 + (50 * batch.column("n").to_numpy() * n_docs) // length
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            ids = batch.column("doc_id")
            none, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            wide = start[term + 1] - start[term]
            sums = np.zeros((batch.num_rows, items), "i8")
            cuts = np.flatnonzero(np.diff(np.cumsum(wide) // CELLS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(term)]):
                w = wide[a:b]
                place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[term[a:b]], w)
                np.add.at(sums, (np.repeat(row[a:b], w), holder[place]), np.repeat(value[a:b], w))
            i, j = np.nonzero((sums > 0) & (sums >= least))
            yield j, sums[i, j], none[i], doc[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, kept, pairs = held.value[3].copy(), [], 0

        def shortened() -> tuple[np.ndarray, ...]:
            rows = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
            return tuple(x[best(*rows, top)] for x in rows)

        for piece in pieces(batches):
            may = piece[1] >= least[piece[0]]
            kept.append(tuple(x[may] for x in piece))
            pairs += int(may.sum())
            if pairs > HELD:
                kept = [shortened()]
                pairs = len(kept[0][0])
                full = np.flatnonzero(np.bincount(kept[0][0], minlength=items) >= top)
                last = np.searchsorted(kept[0][0], full, "right") - 1
                least[full] = np.maximum(least[full], kept[0][1][last])
        if kept:
            item, score, none, doc = shortened()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """Written (key, item_id, terms, n): the distinct terms of every item that has any."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(folded(x.as_py()).split())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.binary()))], ["item_id", "terms"])

    made = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    return materialize(made.select(F.monotonically_increasing_id().alias("key"), "item_id", "terms", F.size("terms").cast("long").alias("n")), "item-terms")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank int, doc_id, score): the best documents of every item."""
    spark = docs.sparkSession
    wanted = item_terms(items)
    n_items, n_words = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n_items // ITEMS), -(-n_words // TERMS))
    found, totals = [], None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").collect()  # of about ITEMS items
        words = sorted({bytes(t) for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(words)}
        pairs = np.array(sorted((number[bytes(t)], i) for i, r in enumerate(rows) for t in r.terms), "i8").reshape(-1, 2)
        starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        counts = term_counts(docs, words)
        if totals is None:
            totals = counts.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        n_docs, length, n_rows = totals
        df = {r.t: r.df for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # of the block's terms
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(words))], "i8")
        score = functools.partial(scored, weights=weights, starts=starts, holders=pairs[:, 1].copy(), items=len(rows), n_docs=n_docs, length=max(length, 1), top=top)
        floor = np.zeros(len(rows), "i8")
        if n_rows > 2 * SAMPLE:
            few = score(counts.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_rows // SAMPLE)) == 0), floor=floor)
            for r in ranked(few, top).where(F.col("rank") == top).collect():  # one row an item
                floor[r["item"]] = r["score"]
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"_item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        top_rows = ranked(score(counts, floor=floor), top)
        found.append(top_rows.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, found)


ORACLE = r"""
WITH said AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), asked AS (
  SELECT key, item_id, unnest(list_distinct(words)) AS term FROM (
    SELECT row_number() OVER () AS key, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM benchmark)
), totals AS (
  SELECT CAST(count(*) FILTER (len(words) > 0) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS length FROM said
), counts AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM said)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, n_docs
), scores AS (
  SELECT a.key, a.item_id, c.r, c.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * c.n * t.n_docs) // t.length)))) AS BIGINT) AS score
  FROM asked a JOIN counts c ON c.term = a.term JOIN weights w ON w.term = a.term, totals t GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) <= 50
"""
