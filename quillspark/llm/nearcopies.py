"""Near copies by five-word SimHash and shingle similarity: one row kept of each component.

The way is op4's, with more bits. Two texts at Jaccard 0.8 differ in about ten of 64 SimHash bits, and tables of agreeing blocks for so
many bits have keys too short to deal a corpus out. So a text's SimHash goes on: ``BANDS`` blocks of ``ROWS`` further bits each, made like the
first 64 from other hashes of the same shingles. A block is the coordinates to references with a single bit set, and there is one table for each
block: texts meet that agree in all coordinates of one (a pair at 0.8 agrees in none with probability 4e-5, unlike texts in a given one with
6e-5). Within what a table deals together, the distances of the fingerprints to the spread-out references are tabulated, pairs are discarded
by the largest coordinate difference, and survivors are those within ``MOST_BITS`` of 64 bits (a pair at 0.8 is beyond with probability 1e-6;
at so many bits the spread-out references discard next to nothing, it is the blocks that narrow) and alike enough in 128 bits (1e-6). What
survives, alike by size and in all the further bits too (1e-6), is verified by the Jaccard similarity of the whole shingle sets. Bits are majorities over distinct shingles, so
that repeats, which Jaccard doesn't see, don't move them. Only sets of four and five shingles, one within the other, differ in more bits for
their similarity; they agree in no block with probability 0.005.

A table's group gives its local components of survivors, each named by its members, so one that meets in many tables is taken once; the
group's other texts go no further. A table's rows hold the key and the 128 bits only, which stand for their text. Each class then goes
to its components (one at most in each table) with its size and all bits, and these narrow them: groups below are the components that are left.

Texts with the same words in the same order (ASCII case and white space aside) are one class, so copies cost one row. Classes that hang
together by groups are one hoard. One of up to ``MOST_CLASSES`` classes and ``MOST_SHINGLES`` shingles is verified whole by one task: each
class's ``NEAREST`` most alike first, then every surviving pair that isn't connected yet; its texts move once. What is larger is verified in two
rounds. The first one takes, of a group of up to ``SMALL`` classes, every surviving pair, and of a larger one the
tree of most alike classes that connects the group and each class with its ``NEAREST`` most alike (groups of more than ``GROUP`` classes are cut
into slices for that, each class also meeting the group's smallest and largest class). That connects what belongs together in nearly
all groups. The second round takes the groups whose classes are still in several components, and in them every surviving pair
from two components that the first one didn't verify; a task cuts a group of more than ``GROUP`` classes into slices, which meet two by two inside
it, and no pair is left out. A pair that agrees in several blocks is taken under the first of them only, and the second round's pairs are never
written: a task names the classes that have any, gets their texts, and goes through the pairs on the spot, the most alike first.

Pairs carry no texts. In the two rounds a pair is verified in one of the groups where it was found, and a text goes once to each of these; there its
shingles are made once, and pairs that are connected already are passed over. Texts of classes that survive with no others never move, and
neither do the rows that are kept: lists of row numbers are joined to them, broadcast up to ``MOST_BROADCAST`` numbers.

Everything is keyed by a row number written once, so null and repeated doc_ids and rows repeated as a whole are rows like any
other. Of each component the row with the smallest doc_id stays (nulls last, then by class and row). Texts of fewer words than a
shingle have one short shingle; null texts and texts without words are one class. Columns stay as they are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize
from .simhash import SEED, _stars, majority, near_pairs, normal_line, pivot_table, shingle_hashes, whole_groups

#: Blocks of further bits, and bits of a block; each block is one table.
BANDS, ROWS = 96, 14
#: Bits in which fingerprints of texts at the similarity in question may differ.
MOST_BITS = 24
#: Classes that meet in a table up to which all pairs are compared at once; in larger groups those reached already aren't compared again.
CROWD = 4_096
#: The same for groups by all bits, whose pairs are dearer.
CLOSE = 64
#: Classes of a group up to which all pairs are verified, most alike classes that are in larger ones, and classes of a slice.
SMALL, NEAREST, GROUP = 8, 4, 512
#: Classes, and shingles of theirs, up to which what hangs together is verified by one task at once.
MOST_CLASSES, MOST_SHINGLES = 4_096, 4_000_000
#: Texts held as shingles at once.
PIECE = 1_000
#: Numbers (of classes or rows) that are broadcast to what holds their texts; more are joined as Spark sees fit.
MOST_BROADCAST = 1_000_000
#: Pairs of the first round that the second one knows of a class; those of classes with more may be verified again.
MOST_TRIED = 500
_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}", SEED) | 1 for i in range(BANDS * ROWS // 64)], "u8")
_TERMS = np.array([xxhash.xxh64_intdigest(f"term {i}", SEED) for i in range(BANDS * ROWS // 64)], "u8")


def shingles(line: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text's words, sorted."""
    return np.unique(shingle_hashes(line, words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def further(hashes: np.ndarray) -> np.ndarray:
    """The words of further SimHash bits of a sorted set of shingles: those set in over half of them. Of two, which are similar to equal
    sets only, the first one decides, so that unlike sets don't agree in all the bits that two hashes seldom share."""
    hashes = hashes[:1] if len(hashes) == 2 else hashes
    ones = np.zeros(BANDS * ROWS, "i8")
    for at in range(0, len(hashes), 255):
        words = (hashes[at : at + 255, None] ^ _TERMS) * _FACTORS
        words = (words ^ words >> np.uint64(32)) * _FACTORS
        words ^= words >> np.uint64(29)
        ones += np.unpackbits(words.view("u1"), axis=1, bitorder="little").sum(axis=0, dtype="u1")
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def words_of(sketches: list[bytes] | np.ndarray) -> np.ndarray:
    """The further words of each text."""
    return np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)


def marks_of(words: np.ndarray) -> np.ndarray:
    """The further bits, a byte each."""
    return np.unpackbits(words.view("u1"), axis=1, bitorder="little")


def band_keys(words: np.ndarray) -> np.ndarray:
    """A key of each text for each table: the number of the table and the bits of its block."""
    bits = marks_of(words).reshape(len(words), BANDS, ROWS)
    return np.packbits(bits, axis=2, bitorder="little").view("<u2")[:, :, 0].astype("i8") + (np.arange(BANDS) << ROWS)


def least_equal(similarity: float, bits: int = BANDS * ROWS) -> int:
    """Equal bits that a pair of this similarity has at least, but for about one pair in a million."""
    equal = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * equal - 4.9 * math.sqrt(bits * equal * (1 - equal)))


def classed(docs: DataFrame, words: int) -> DataFrame:
    """docs with a row number _nc_row, the class and fingerprint of the text (_nc_class, _nc_fp), its number of shingles _nc_size, its
    further bits _nc_sketch and the first word of these, _nc_more; written, so that all stay as they are."""
    own = {"_nc_class": "bigint", "_nc_fp": "bigint", "_nc_size": "bigint", "_nc_sketch": "binary", "_nc_more": "bigint"}
    schema = docs.withColumns({c: F.lit(None).cast(t) for c, t in own.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            lines = [normal_line(x.as_py()) for x in batch.column("text")]
            classes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in lines], "u8").view("i8")
            fps, sizes, sketches = [], [], []
            for x in lines:
                distinct = shingles(x, words)
                fps.append(majority(distinct))
                sizes.append(len(distinct))
                sketches.append(further(distinct).tobytes())
            more = words_of(sketches)[:, 0].view("i8")
            made = [pa.array(classes), pa.array(np.array(fps, "u8").view("i8")), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return materialize(docs.mapInArrow(run, schema).withColumn("_nc_row", F.monotonically_increasing_id()), "near-classes")


def may_be_similar(i: np.ndarray, j: np.ndarray, size: np.ndarray, marks: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) are alike enough by size and equal marks; at most some thousands at once are compared."""
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    # Four shingles and five differ in 3 bits of 16, more than other sets of their similarity: they are verified as they are.
    least, out = least_equal(similarity), (low >= similarity * high) & (low == 4)
    keep = np.flatnonzero((low >= similarity * high) & (low != 4))
    for part in np.array_split(keep, len(keep) // 1_000 + 1):
        out[part] = (marks[i[part]] == marks[j[part]]).sum(axis=1) >= least
    return out


def forest(fp: np.ndarray, size: np.ndarray, marks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that may be similar: the tree of the most alike ones, and each with its NEAREST most alike."""
    n, none = len(fp), np.iinfo("u2").max
    gap = np.empty((n, n), "u2")
    for i in range(n):
        gap[i] = marks.shape[1] - (marks == marks[i]).sum(axis=1)
    unlike = np.minimum(size[:, None], size[None, :]) < similarity * np.maximum(size[:, None], size[None, :])
    far = (gap > marks.shape[1] - least_equal(similarity)) & (np.minimum(size[:, None], size[None, :]) != 4)
    gap[unlike | far | (np.bitwise_count(fp[:, None] ^ fp[None, :]) > MOST_BITS)] = none
    np.fill_diagonal(gap, none)
    near = np.argpartition(gap, min(NEAREST, n - 1), axis=1)[:, :NEAREST]
    us, vs = [np.repeat(np.arange(n), near.shape[1])], [near.ravel()]
    # Prim's tree: the outsider most like the tree joins it next.
    best, of, outside = gap[0].copy(), np.zeros(n, "i8"), np.ones(n, bool)
    outside[0] = False
    for _ in range(n - 1):
        x = int(np.where(outside, best, none).argmin())
        if not outside[x]:
            x = int(outside.argmax())
        outside[x] = False
        us.append(np.array([of[x]]))
        vs.append(np.array([x]))
        closer = gap[x] < best
        best[closer], of[closer] = gap[x][closer], x
    u, v = np.concatenate(us), np.concatenate(vs)
    fine = gap[u, v] < none
    return u[fine], v[fine]


def _pairs(group: np.ndarray, fp: np.ndarray, size: np.ndarray, marks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs, from rows of whole groups in group order."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(group)]))
    sizes = ends - starts
    table, us, vs = pivot_table(fp), [], []
    small, left = np.repeat(sizes <= SMALL, sizes), np.repeat(ends, sizes) - np.arange(len(group)) - 1
    for step in range(1, SMALL):
        i = np.flatnonzero(small & (left >= step))
        i = i[near_pairs(fp, table, i, i + step, MOST_BITS)]
        i = i[may_be_similar(i, i + step, size, marks, similarity)]
        us.append(i)
        vs.append(i + step)
    for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
        u, v = forest(fp[a:b], size[a:b], marks[a:b], similarity)
        us.append(u + a)
        vs.append(v + a)
    return np.concatenate(us), np.concatenate(vs)


def _alike(fp: np.ndarray, more: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) survive the coordinate filter and the checks of bits."""
    near = near_pairs(fp, table, i, j, MOST_BITS)
    a, b = i[near], j[near]
    near[near] = np.bitwise_count(fp[a] ^ fp[b]).astype("i8") + np.bitwise_count(more[a] ^ more[b]) <= 128 - least_equal(similarity, 128)
    return near


def _local(group: np.ndarray, crowd: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For rows of whole groups, in group order, the first row of each one's component of pairs (i, j) that are alike."""
    n = len(group)
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
    sizes = ends - starts
    us, vs, held = [np.zeros(0, "i8")], [np.zeros(0, "i8")], 0
    left = np.repeat(ends, sizes) - np.arange(n) - 1  # rows of the group that follow
    rows, step = np.flatnonzero(np.repeat(sizes <= crowd, sizes)), 0
    while len(rows := rows[left[rows] > step]):
        step += 1
        i = rows[alike(rows, rows + step)]
        us.append(i)
        vs.append(i + step)
        held += len(i)
        if held > 20 * n:  # no more than a crowd's stars are kept of its pairs
            root = _stars(np.concatenate(us), np.concatenate(vs), n)
            us, vs, held = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]], 0
    for a, b in zip(starts[sizes > crowd].tolist(), ends[sizes > crowd].tolist(), strict=True):
        rest, queue = np.arange(a, b), []
        while len(rest):
            if not queue:
                queue.append(int(rest[0]))
                rest = rest[1:]
            x = queue.pop()
            near = alike(np.full(len(rest), x), rest)
            us.append(np.full(int(near.sum()), x))
            vs.append(rest[near])
            queue += rest[near].tolist()
            rest = rest[~near]
    return _stars(np.concatenate(us), np.concatenate(vs), n)


def local_components(group: np.ndarray, fp: np.ndarray, more: np.ndarray, similarity: float) -> np.ndarray:
    """For rows of whole groups, in group order, the first row of each one's component of surviving pairs."""
    table = pivot_table(fp)
    return _local(group, CROWD, lambda i, j: _alike(fp, more, table, i, j, similarity))


def fine_components(group: np.ndarray, fp: np.ndarray, size: np.ndarray, words: np.ndarray, similarity: float) -> np.ndarray:
    """The same by all bits and the sizes: components of the pairs that are left to verify."""
    table, marks = pivot_table(fp), marks_of(words)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = near_pairs(fp, table, i, j, MOST_BITS)
        near[near] = may_be_similar(i[near], j[near], size, marks, similarity)
        return near

    return _local(group, CLOSE, alike)


def _named(root: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, sizes) of the components' rows that aren't alone. A name is the sum of its rows' ids, which are hashes."""
    count, name = np.bincount(root, minlength=len(root)), np.zeros(len(root), "u8")
    np.add.at(name, root, ids)
    some = np.flatnonzero(count[root] > 1)
    return some, name.view("i8")[root[some]], count[root[some]]


def _distinct(*columns: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Places of one row of each distinct one of columns, the one with the least by, in their order."""
    order = np.lexsort((*([] if by is None else [by]), *columns[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)
    return order[new]


def shared_keys(one: DataFrame, similarity: float) -> DataFrame:
    """Written (fp, more, ks, firsts): for the fingerprint and first further word of each class, its local components with others in any table and the
    keys under which these met, at most one for each table. The two words stand for the class, so that a table's rows hold nothing else."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            keys = band_keys(words_of(batch.column("sketch").to_pylist()))
            made = [keys.ravel(), *[np.repeat(np.asarray(batch.column(c)), BANDS) for c in ("fp", "more")]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["k", "fp", "more"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, more in whole_groups(batches, ["k", "fp", "more"], 20_000):
            root = local_components(key, fp.view("u8"), more.view("u8"), similarity)
            some, name, _ = _named(root, fp.view("u8") * _FACTORS[0] ^ more.view("u8") * _FACTORS[1])
            at = _distinct(key[some], fp[some], more[some])
            some, name = some[at], name[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, fp[some], more[some], key[some])], ["g", "fp", "more", "first"])

    keyed = one.where("size > 0").select("fp", "more", "sketch").mapInArrow(deal, "k long, fp long, more long")
    # At least as many tasks as tables: every text has a row in each, which is much for a few tasks.
    tasks = max(BANDS, int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = keyed.repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(meet, "g long, fp long, more long, first long")
    return materialize(met.groupBy("fp", "more").agg(F.collect_list("g").alias("ks"), F.collect_list("first").alias("firsts")), "near-met")


def shared_groups(met: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """Written (k, c, first, n, hub): every class c in each component k of a local component of met (shared_keys) by all bits, with the least key under
    which these met, their number n and one of them. What is alike in two words only ends here, so groups hold next to none but pairs that are verified."""
    few = met.select("fp", "more")
    some = materialize(one.join(_short_list(few), ["fp", "more"], "left_semi").select("c", "fp", "more", "size", "sketch"), "near-some")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("ks").offsets)))
            k, first = (np.asarray(batch.column(c).flatten()) for c in ("ks", "firsts"))
            at, own = _distinct(of, k, by=first), ["fp", "c", "size", "sketch"]
            for part in np.array_split(at, len(at) // 10_000 + 1):
                made = [pa.array(k[part]), pa.array(first[part]), *[batch.column(c).take(pa.array(of[part])) for c in own]]
                yield pa.RecordBatch.from_arrays(made, ["k", "first", *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, ids, first, size, sketch in whole_groups(batches, ["k", "fp", "c", "first", "size", "sketch"], 2_000):
            root = fine_components(group, fp.view("u8"), size, words_of(sketch), similarity)
            rows, name, n = _named(root, ids.view("u8"))
            hub = ids.copy()
            np.minimum.at(hub, root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, ids[rows], first[rows], n, hub[root[rows]])], ["g", "c", "first", "n", "hub"])

    each = met.join(some, ["fp", "more"]).select("ks", "firsts", "fp", "c", "size", "sketch").mapInArrow(spread, "k long, first long, fp long, c long, size long, sketch binary")
    fine = each.repartition("k").sortWithinPartitions("k").mapInArrow(run, "g long, c long, first long, n long, hub long")
    shared = materialize(fine.groupBy(F.col("g").alias("k"), "c").agg(F.min("first").alias("first"), F.max("n").alias("n"), F.min("hub").alias("hub")), "near-shared")
    discard(some)
    return shared


def _pair_rows(g: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    u, v = ids[i], ids[j]
    rows = np.searchsorted(g, g[i], "right") - np.searchsorted(g, g[i])
    return pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(rows), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["g", "rows", "u", "v"])


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair in the largest of the groups where it was found, which its texts then most often share with others."""
    return pairs.groupBy("u", "v").agg(F.max_by("g", F.struct("rows", "g")).alias("g"))


def candidates(shared: DataFrame, short: DataFrame, similarity: float) -> DataFrame:
    """(u, v, g): the pairs of the first round, each with a group that holds both."""
    part = F.xxhash64("k", F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / GROUP)))
    groups = shared.select(F.when(F.col("n") <= GROUP, F.col("k")).otherwise(part).alias("g"), "c")
    groups = groups.join(short.select("c", "fp", "size", "sketch"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, ids, size, sketch in whole_groups(batches, ["g", "fp", "c", "size", "sketch"], 2_000):
            yield _pair_rows(group, ids, *_pairs(group, fp.view("u8"), size, marks_of(words_of(sketch)), similarity))

    close = groups.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, rows long, u long, v long")
    large = shared.where(F.col("n") > GROUP)
    hubs = large.groupBy(F.col("k").alias("hk")).agg(F.array(F.min("c"), F.max("c")).alias("ends"))
    ends = large.join(hubs, F.col("k") == F.col("hk")).select(part.alias("g"), F.explode("ends").alias("u"), F.col("c").alias("v")).where("u <> v")
    return _once(close.unionByName(ends.select("g", F.lit(GROUP).cast("long").alias("rows"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))))


def _across(some: dict[str, np.ndarray], marks: np.ndarray, bands: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of one block of a key's group, from two components, that may be similar, agree in no earlier table and weren't verified
    yet; the most alike first."""
    part, component, ids, fp = some["part"], some["component"], some["c"], some["fp"].view("u8")
    us, vs, two = [np.zeros(0, "i8")], [np.zeros(0, "i8")], part[0] != part[-1]
    for i in range(len(fp) - 1):
        # Rows come in order of their slices; a block of two slices compares rows of different ones only.
        j = np.arange(int(np.searchsorted(part, part[i], "right")) if two else i + 1, len(fp))
        j = j[component[j] != component[i]]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= MOST_BITS]
        j = j[may_be_similar(np.full(len(j), i), j, some["size"], marks, similarity)]
        if len(j):
            j = j[bands[j, (bands[j] == bands[i]).argmax(axis=1)] == some["first"][0]]
        us.append(np.full(len(j), i))
        vs.append(j)
    u, v = np.concatenate(us), np.concatenate(vs)
    order = np.argsort(ids)
    partners = np.concatenate([np.zeros(0, "i8"), *some["tried"]]).astype("i8")
    place = order[np.minimum(np.searchsorted(ids, partners, sorter=order), len(ids) - 1)]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in some["tried"]])
    known = ids[place] == partners
    done = np.minimum(owner, place)[known] * len(ids) + np.maximum(owner, place)[known]
    new = ~np.isin(u * len(ids) + v, done)
    u, v = u[new], v[new]
    alike = np.concatenate([(marks[u[at : at + 1_000]] == marks[v[at : at + 1_000]]).sum(axis=1) for at in range(0, len(u), 1_000)] or [np.zeros(0, "i8")])
    order = np.argsort(-alike, kind="stable")
    return u[order], v[order]


BLOCK = "g long, first long, part long, c long, component long, fp long, size long, sketch binary, tried array<long>"


def _slices(some: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of one group: itself, or if it is large each of its slices and each two of them, but for those of one component."""
    n, g, component = len(some["c"]), int(some["g"][0]), some["component"]
    if n <= GROUP or some["part"].any():  # small, or cut before
        yield some
        return
    part = np.arange(n) // GROUP
    ends = [(p * GROUP, min(n, (p + 1) * GROUP)) for p in range(part[-1] + 1)]
    for (p, (a, b)), (q, (c, d)) in itertools.combinations_with_replacement(enumerate(ends), 2):
        at = np.arange(a, b) if p == q else np.concatenate((np.arange(a, b), np.arange(c, d)))
        if (component[at] != component[a]).any():
            name = np.array(xxhash.xxh64_intdigest(f"{g} {p} {q}", SEED), "u8").view("i8")
            yield {k: x[at] for k, x in some.items()} | {"g": np.full(len(at), name), "part": part[at]}


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float, columns: list[str], least: int) -> Iterator[tuple]:
    """(rows, i, j) of each block of the groups g, in order of their parts: its columns and the pairs to verify."""
    for rows in whole_groups(batches, columns, least):
        cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), len(rows[0])]
        for a, b in itertools.pairwise(cuts):
            for some in _slices(dict(zip(columns, (x[a:b] for x in rows), strict=True))):
                more = words_of(some["sketch"])
                yield some, *_across(some, marks_of(more), band_keys(more), similarity)


def across(shared: DataFrame, short: DataFrame, seen: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """Rows of blocks: the classes of linked (id, component), or alone, that may be similar to one of another component in the block, by pairs that
    aren't among those seen (u, v)."""
    few = seen.groupBy(F.col("u").alias("few")).count().where(F.col("count") <= MOST_TRIED).select("few")
    tried = seen.join(few, F.col("u") == F.col("few"), "left_semi").groupBy(F.col("u").alias("tu")).agg(F.collect_list("v").alias("tried"))
    placed = short.drop("row").join(linked, F.col("c") == F.col("id"), "left").withColumn("component", F.coalesce("component", "c")).drop("id")
    placed = placed.join(tried, F.col("c") == F.col("tu"), "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<long>"))).drop("tu")
    placed = materialize(placed, "near-placed")
    keyed = shared.select("k", "c", "n").join(placed.select("c", "component"), "c")
    open_keys = keyed.groupBy(F.col("k").alias("ok")).agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("ok")
    open_keys = materialize(open_keys, "near-open")
    columns = [x.split()[0] for x in BLOCK.split(", ")]
    dealt = shared.join(open_keys, F.col("k") == F.col("ok"), "left_semi").select(F.col("k").alias("g"), "first", F.lit(0).cast("long").alias("part"), "c")
    groups = dealt.join(placed, "c").select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, j in _blocks(batches, similarity, columns, 5_000):
            kept = np.unique(np.concatenate((i, j)))
            if len(kept):
                made = [pa.array([bytes(x) for x in rows[c][kept]], pa.binary()) if c == "sketch" else pa.array(list(rows[c][kept]), pa.list_(pa.int64())) if c == "tried" else pa.array(rows[c][kept]) for c in columns]
                yield pa.RecordBatch.from_arrays(made, columns)

    return groups.repartition("g").sortWithinPartitions("g", "component").mapInArrow(run, BLOCK)


def verified_blocks(rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): pairs of the blocks' rows (across) whose texts (c, t) are at least so similar, those that connect each block."""
    columns = [x.split()[0] for x in BLOCK.split(", ")] + ["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, i, j in _blocks(batches, similarity, columns, 500):
            of: dict[int, np.ndarray] = {}
            root: dict[int, int] = {}

            def set_of(x: int) -> np.ndarray:
                if x not in of:  # noqa: B023
                    of[x] = shingles(normal_line(some["t"][x]), words)  # noqa: B023
                return of[x]  # noqa: B023

            us, vs = [], []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = _find(root, int(some["component"][x])), _find(root, int(some["component"][y]))
                if a != b and jaccard(set_of(x), set_of(y)) >= similarity:
                    root[a] = b
                    us.append(some["c"][x])
                    vs.append(some["c"][y])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    held = rows.join(texts, "c").select(columns)
    return held.repartition("g").sortWithinPartitions("g", "part").mapInArrow(run, "u long, v long")


def _find(root: dict[int, int], x: int) -> int:
    """The representative of x in a forest of parents."""
    while root.setdefault(x, x) != x:
        root[x] = x = root[root[x]]
    return x


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): of the pairs (u, v, g) whose texts (c, t) are at least so similar, those that connect each group."""
    needed = pairs.select("g", F.explode(F.array("u", "v")).alias("c")).distinct().join(texts, "c")
    held = needed.select("g", F.lit(False).alias("pair"), F.col("c").alias("u"), F.col("c").alias("v"), "t")
    both = held.unionByName(pairs.select("g", F.lit(True).alias("pair"), "u", "v", F.lit(None).cast("string").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}
        group = None

        for batch in batches:
            us, vs = [], []
            for g, pair, u, v, t in zip(*[batch.column(c).to_pylist() for c in ("g", "pair", "u", "v")], batch.column("t"), strict=True):
                if g != group:
                    of, root, group = {}, {}, g
                if not pair:
                    of[u] = shingles(normal_line(t.as_py()), words)
                elif (a := _find(root, u)) != (b := _find(root, v)) and jaccard(of[u], of[v]) >= similarity:
                    root[a] = b
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return both.repartition("g").sortWithinPartitions("g", "pair").mapInArrow(run, "u long, v long")


def _survivors(i: int, fp: np.ndarray, size: np.ndarray, more: np.ndarray, table: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The later rows j that row i has to be verified with, and in how many further bits they differ."""
    j = np.arange(i + 1, len(fp))
    j = j[near_pairs(fp, table, np.full(len(j), i), j, MOST_BITS)]
    low, high = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
    j, low = j[low >= similarity * high], low[low >= similarity * high]
    gap = np.bitwise_count(more[j] ^ more[i]).sum(axis=1, dtype="i8")
    near = (gap <= BANDS * ROWS - least_equal(similarity)) | (low == 4)  # as in may_be_similar
    return j[near], gap[near]


def linked_whole(fp: np.ndarray, size: np.ndarray, more: np.ndarray, texts: np.ndarray, words: int, similarity: float) -> list[tuple[int, int]]:
    """Places of pairs that connect rows as all pairs of the similarity do: each row's NEAREST most alike first, then all others that aren't
    connected yet. Only one row's pairs are held at a time."""
    table, of, root, tried, out = pivot_table(fp), {}, {}, set(), []

    def set_of(x: int) -> np.ndarray:
        if x not in of:
            of[x] = shingles(normal_line(texts[x]), words)
        return of[x]

    for most in (NEAREST, len(fp)):
        if len({_find(root, x) for x in range(len(fp))}) == 1:
            break
        for i in range(len(fp) - 1):
            j, gap = _survivors(i, fp, size, more, table, similarity)
            for x in j[np.argsort(gap, kind="stable")[:most]].tolist():
                a, b = _find(root, i), _find(root, x)
                if a != b and (i, x) not in tried:
                    if jaccard(set_of(i), set_of(x)) >= similarity:
                        root[a] = b
                        out.append((i, x))
                    elif most == NEAREST:
                        tried.add((i, x))
    return out


def verified_whole(groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): pairs that connect the classes of each group of groups (g, c, fp, size, sketch, t) as all pairs do whose texts t are at least so similar."""
    columns = ["g", "c", "fp", "size", "sketch", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, columns, 500):
            cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), len(rows[0])]
            for a, b in itertools.pairwise(cuts):
                _, ids, fp, size, sketch, t = (x[a:b] for x in rows)
                pairs = linked_whole(fp.view("u8"), size, words_of(sketch), t, words, similarity)
                u, v = np.array(pairs, "i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    return groups.select(columns).repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def _short_list(ids: DataFrame) -> DataFrame:
    """A written list of numbers, marked for a broadcast if it is short."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def components(one: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Written (id, component) of the linked classes of one (c, row, fp, size, sketch, more), whose texts are in rows (_nc_row, text)."""
    words_met = shared_keys(one, similarity)
    groups = shared_groups(words_met, one, similarity)
    discard(words_met)
    shared, met = groups, materialize(groups.select("c").distinct(), "near-grouped")
    short = materialize(one.drop("more").join(_short_list(met), "c", "left_semi"), "near-short")
    own = {"_nc_row": "_nc_row", "_nc_fp": "fp", "_nc_size": "size", "_nc_sketch": "sketch", "text": "t"}
    texts = rows.select(*[F.col(c).alias(to) for c, to in own.items()]).join(_short_list(short.select("row", "c")), F.col("_nc_row") == F.col("row"))
    full = materialize(texts.select("c", "fp", "size", "sketch", "t"), "near-texts")
    texts = full.select("c", "t")
    # What hangs together by pairs to verify; most of it is small enough to be gone through whole.
    whole = materialize(connected_components(shared.select(F.col("c").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("component", "g"), "near-whole")
    held = short.select("c", "size").join(whole, F.col("c") == F.col("id"))
    fits = (F.count("*") <= MOST_CLASSES) & (F.sum("size") <= MOST_SHINGLES)
    large = materialize(held.groupBy("g").agg(fits.alias("fits")).where("not fits").select("g"), "near-large")
    small = materialize(whole.join(large, "g", "left_anti").select("id", "g"), "near-small")
    at_once = verified_whole(full.join(_short_list(small), F.col("c") == F.col("id")), words, similarity)
    shared = shared.join(whole.join(large, "g", "left_semi").select("id"), F.col("c") == F.col("id"), "left_semi")
    seen = materialize(candidates(shared, short, similarity), "near-pairs")
    linked = materialize(connected_components(at_once.unionByName(verified(seen, texts, words, similarity))), "near-linked")
    rest = materialize(across(shared, short, seen, linked, similarity), "near-rest")
    edges = materialize(verified_blocks(rest, texts, words, similarity), "near-edges")
    if not edges.isEmpty():
        known = linked.select(F.col("id").alias("u"), F.col("component").alias("v"))
        linked = materialize(connected_components(known.unionByName(edges)), "near-linked")
    for old in (groups, met, short, full, whole, large, small, seen, rest, edges):
        discard(old)
    return linked


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component of texts whose shingle sets have at least this Jaccard similarity."""
    rows = classed(docs, words)
    names = {"_nc_class": "c", "_nc_row": "row", "_nc_fp": "fp", "_nc_size": "size", "_nc_sketch": "sketch", "_nc_more": "more"}
    one = materialize(rows.select(*[F.col(c).alias(to) for c, to in names.items()]).dropDuplicates(["c"]), "near-one")
    linked = components(one, rows, words, similarity)
    discard(one)
    named = linked.select(F.col("id").alias("_nc_id"), F.col("component").alias("_nc_component"))
    placed = rows.select("doc_id", "_nc_class", "_nc_row").join(named, F.col("_nc_class") == F.col("_nc_id"), "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_nc_class", "_nc_row")
    first = placed.groupBy(F.coalesce("_nc_component", "_nc_class").alias("_nc_component")).agg(F.min(order).alias("first")).select(F.col("first._nc_row").alias("_nc_row"))
    gone = materialize(rows.select("_nc_row").join(first, "_nc_row", "left_anti"), "near-gone")
    return rows.join(_short_list(gone), "_nc_row", "left_anti").select(docs.columns)
