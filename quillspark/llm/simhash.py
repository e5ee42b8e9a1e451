"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Equal fingerprints are one class, so
copies cost one row however many there are. Classes within ``distance`` bits are linked as follows.

* The reference fingerprints come in two kinds. Those with a single bit set, taken block by block, give coordinates from
  which a block of the fingerprint can be read off; two fingerprints within d bits differ in at most d of d + c blocks, so
  they agree in all those coordinates for some c blocks. One table per choice of c blocks deals the classes out by them.
* Within what a table deals together, the distances to ``PIVOTS`` spread-out references are tabulated; a pair is discarded
  if any coordinate differs by more than d (the triangle inequality), and survivors are verified bit by bit.

No link is lost. A table's row names a class and the smallest one of its local component, so output is linear even
where all members are similar; groups too large for one task are first cut again by the same rule over their other bits, as
often as it takes.

Null texts have no words; a text without words has fingerprint zero and is linked like any other; fewer words than a shingle
make one short shingle; repeated rows share a class. Rows with null doc_id get the component of their fingerprint's class
and null if no document with an id has it. Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SEED = 42
#: Reference fingerprints for the distance tables.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(32)], "u8")
#: Classes that share a key beyond this are dealt out again by their other bits.
GROUP_LIMIT = 100_000


def normal_line(text: str | None) -> bytes:
    """A text's words, ASCII letters in lower case, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(line: bytes, words: int) -> np.ndarray:
    """The hash of each shingle of a line's words, repeats included; one short shingle if there are fewer words."""
    if not line:
        return np.zeros(0, "<u8")
    digest, parts = xxhash.xxh64_intdigest, line.split(b" ")
    if len(parts) <= words:
        return np.array([digest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), "i8", len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    return majority(shingle_hashes(normal_line(text), words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], "u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view("i8"))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(bits: list[int], n: int) -> list[int]:
    """n masks over the given bit numbers, as even as can be."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def table_masks(classes: int, distance: int) -> list[int]:
    """One mask per table: the blocks whose coordinates have to agree. More classes, more bits to agree in."""
    agree = 2 if classes <= 1 << 24 else 3 if classes <= 1 << 30 else 4
    blocks = _blocks(list(range(64)), distance + agree)
    return [sum(choice) for choice in itertools.combinations(blocks, agree)]


def _stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable for each of n nodes over the edges u - v."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(up := root[root], root):
            root = up
        keep = root[u] != root[v]
        u, v = u[keep], v[keep]
    return root


def near_pairs(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs (i, j) survive the coordinate filter and the check of their bits."""
    keep = np.arange(len(i))
    for part in range(0, table.shape[1], 8):
        gap = np.abs(table[i[keep], part : part + 8] - table[j[keep], part : part + 8]).max(axis=1)
        keep = keep[gap <= distance]
    out = np.zeros(len(i), bool)
    out[keep] = np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= distance
    return out


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every reference."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype("i1")


def _large_group(fp: np.ndarray, table: np.ndarray, distance: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect a group as all its links do. Fingerprints agree outside mask's complement."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(fp) > 4096 and len(free) > distance:
        us, vs = [], []
        for block in _blocks(free, distance + 1):
            key = fp & np.uint64(block)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    u, v = _large_group(fp[part], table[part], distance, mask | block)
                    us.append(part[u])
                    vs.append(part[v])
        return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, "i8"), np.zeros(0, "i8"))
    # Breadth first: whoever has been reached need not be compared with others reached.
    rest, us, vs = np.arange(len(fp)), [], []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        x = queue.pop()
        near = near_pairs(fp, table, np.full(len(rest), x), rest, distance)
        found = rest[near]
        rest = rest[~near]
        us.append(np.full(len(found), x))
        vs.append(found)
        queue += found.tolist()
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def _link(group: np.ndarray, mask: np.ndarray, fp: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole groups, in group order: (id, smallest id of its local component), for linked ones only."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(group)]))
    sizes = ends - starts
    table = pivot_table(fp)
    us, vs = [], []
    small = np.repeat(sizes <= 64, sizes)
    left = np.repeat(ends, sizes) - np.arange(len(group)) - 1  # rows of the group that follow
    for step in range(1, 64):
        i = np.flatnonzero(small & (left >= step))
        if not len(i):
            break
        hit = near_pairs(fp, table, i, i + step, distance)
        us.append(i[hit])
        vs.append(i[hit] + step)
    for a, b in zip(starts[sizes > 64], ends[sizes > 64], strict=True):
        u, v = _large_group(fp[a:b], table[a:b], distance, int(mask[a]))
        us.append(u + a)
        vs.append(v + a)
    u, v = np.concatenate(us or [np.zeros(0, "i8")]), np.concatenate(vs or [np.zeros(0, "i8")])
    order = np.argsort(ids, kind="stable")  # so that the smallest index is the smallest id
    place = np.empty(len(ids), "i8")
    place[order] = np.arange(len(ids))
    root = _stars(place[u], place[v], len(ids))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[order][moved], ids[order][root[moved]]


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of whole groups, at least so many at a time, of batches that are sorted by the first column."""
    held: list[tuple] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(tuple(np.asarray(batch.column(c)) for c in columns))
            if sum(len(x[0]) for x in held) < least:
                continue
        if not held:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        group = rows[0]
        whole = len(group) if batch is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
        held = [tuple(x[whole:] for x in rows)] if whole < len(group) else []
        if whole:
            yield tuple(x[:whole] for x in rows)


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): edges between class ids that connect the classes (fp, id) as all pairs within distance do."""
    masks = [_signed(m) for m in table_masks(classes.count(), distance)]
    tables = F.array(*[F.struct(F.lit(m).alias("mask"), F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m))).alias("g")) for m in masks])
    keyed = classes.select("id", "fp", F.explode(tables).alias("t")).select("id", "fp", "t.mask", "t.g")
    done = None
    while True:
        hot = keyed.groupBy("g", "mask").count().where(F.col("count") > GROUP_LIMIT).select("g", "mask")
        hot = materialize(hot, "hot-groups")
        crowded = [r.mask for r in hot.select("mask").distinct().collect()]  # of the few masks, not of the groups
        if not crowded:
            break
        # Each hot group again by the blocks of its other bits: close pairs agree in at least one of them. Members differ, so
        # groups shrink with every round.
        finer = []
        for m in crowded:
            free = [b for b in range(64) if not (m & (1 << 64) - 1) >> b & 1]
            finer += [(m, _signed(x)) for x in _blocks(free, distance + 1)]
        blocks = classes.sparkSession.createDataFrame(finer, "mask long, more long")
        cold = keyed.join(hot.select("g"), "g", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        again = keyed.join(hot, ["g", "mask"], "left_semi").join(F.broadcast(blocks), "mask")
        regrouped = F.xxhash64("g", "more", F.col("fp").bitwiseAND(F.col("more")))
        keyed = materialize(again.select("id", "fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"), regrouped.alias("g")), "finer-groups")
    keyed = keyed if done is None else done.unionByName(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, mask, fp, ids in whole_groups(batches, ["g", "mask", "fp", "id"]):
            u, v = _link(group, mask.view("u8"), fp.view("u8"), ids, distance)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return keyed.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """(_fp, component_id) of each fingerprint of prints (doc_id, fp)."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")), "classes")
    edges = links(classes.where("id is not null"), distance)
    linked = connected_components(edges)
    return classes.join(linked.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "id").alias("component_id"))


def components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    return prints.join(_named(prints, distance), F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """docs without those that another document of their component stands for: the rows with its smallest doc_id stay.

    Rows are judged by their own fingerprint, so a repeated doc_id with different texts loses only those that have a copy.
    Rows without an id stay, and so do all rows of the smallest doc_id; ``nearcopies.keep_one`` keeps a single row.
    """
    schema = docs.withColumn("_row_fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], "u8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view("i8"))], schema.names)

    rows = docs.mapInArrow(run, schema)
    prints = materialize(rows.select("doc_id", F.col("_row_fp").alias("fp")), "fingerprints")
    gone = prints.join(_named(prints, distance), F.col("fp") == F.col("_fp"), "left").where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("fp").alias("_gone_fp")).distinct()
    return rows.join(gone, (rows["doc_id"] == gone["_gone"]) & (rows["_row_fp"] == gone["_gone_fp"]), "left_anti").select(docs.columns)
