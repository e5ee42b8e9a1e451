"""Near-duplicate vectors by an inverted multi-index.

Each vector is cut into two halves with a codebook each; a pair of nearest codewords is its cell in the product grid. A vector
visits the cells of the grid in the order of a lower bound on its distance to whatever lies in them (the sum over the halves of the
squared distance to the border between its own codeword's region and the other's), and stops at a bound. At the squared
distance that the threshold allows, no close pair can be missed (target recall 1, the default); for a lower target the
stop is the quantile of that bound among close pairs simulated from the sample. Candidates are then verified exactly.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors, the first by hash); every vector is indexed. Their size grows with the
square root of the vectors per label from ``LEAST_WORDS`` up, so cells stay even as data grow. Equal vectors are one class.

A vector isn't sent to every cell that it visits: neighbouring cells are packed, by the sample's counts, into packets of about ``TILE``
vectors, and a vector goes once to each packet that it has to visit, with the numbers of the cells there; it is compared with
those cells' vectors only. Packets that turn out larger are cut into tiles of bounded size, so a crowded cell is spread over tasks; each
task returns counts and the local component of its rows, never pairs.

Vectors link only within an equal, non-null label and length. Null, zero and non-finite vectors and those with null components or
null labels link with nothing. Repeated rows (equal vec_id) are vectors of their own in n_links and share a component. Rows with null
vec_id count as links of others, have their component's smallest vec_id (null if it has none) and aren't kept. An empty table gives
no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Vectors at most that codebooks are fitted on.
SAMPLE = 8_000
#: Vectors that a cell should hold, codewords at least and at most, vectors of a tile, and visitors that a tile meets in one task.
CELL, LEAST_WORDS, MOST_WORDS, TILE, VISITORS = 400, 16, 1_024, 8_192, 65_536


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that no square overflows."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def codebook(points: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start; fewer words where points coincide."""
    words = max(1, min(words, len(points)))
    centre = points[np.random.default_rng(5).permutation(len(points))[:words]].copy()
    for _ in range(rounds):
        near = _squared(points, centre).argmin(axis=1)
        size = np.bincount(near, minlength=words)
        for d in range(points.shape[1]):
            sums = np.bincount(near, points[:, d], minlength=words)
            centre[:, d] = np.where(size > 0, sums / np.maximum(size, 1), centre[:, d])
    return np.unique(centre, axis=0)


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centre.T + (centre**2).sum(axis=1), 0)


def border_bounds(points: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each point, and the squared distance to the border of every other codeword's region."""
    squared = _squared(points, centre)
    own = squared.argmin(axis=1)
    gap = np.sqrt(_squared(centre, centre))[own]
    beyond = (squared - squared[np.arange(len(points)), own][:, None]) / (2 * np.where(gap > 0, gap, np.inf))
    return own, np.maximum(beyond - 1e-9, 0) ** 2


def multi_sequence(first: np.ndarray, second: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells (i, j) in rising order of first[i] + second[j], up to stop.

    Both sequences are sorted; for each entry of the first, the second is followed as far as the sum allows, and the runs
    are merged by their sums.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    reach = np.searchsorted(second[b], stop - first[a], side="right")
    reach[first[a] > stop] = 0
    i = np.repeat(a, reach)
    j = b[np.concatenate([np.arange(r) for r in reach])] if len(i) else i
    order = np.argsort(first[i] + second[j], kind="stable")
    return i[order], j[order]


def stop_bound(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> float:
    """Where traversal may stop: exactly safe for recall 1, else the recall quantile over simulated pairs at the threshold."""
    safe = 2 - 2 * threshold + 1e-9
    if recall >= 1:
        return safe
    rng = np.random.default_rng(7)
    step = rng.normal(size=sample.shape)
    step -= np.einsum("ij,ij->i", step, sample)[:, None] * sample
    angle, size = math.acos(threshold), np.linalg.norm(step, axis=1)[:, None]
    other = math.cos(angle) * sample + math.sin(angle) * step / np.where(size > 0, size, 1)
    need = np.zeros(len(sample))
    for mine, theirs, book in zip(_halves(sample), _halves(other), books, strict=True):
        need += border_bounds(mine, book)[1][np.arange(len(sample)), _squared(theirs, book).argmin(axis=1)]
    return min(safe, float(np.quantile(need, recall)) + 1e-9)


def _usable() -> Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))


def _key() -> Column:
    return F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64(F.lit(1), "label", "embedding").alias("b"))


def vector_classes(rows: DataFrame) -> DataFrame:
    """(c long, id, n, label, embedding, k): usable vectors, equal ones once; id is the smallest vec_id, c a number of the written
    row, and k a 128-bit hash of label and vector that stands for them in joins."""
    one = rows.where("k is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return materialize(one.withColumn("k", _key()).withColumn("c", F.monotonically_increasing_id()), "vector-classes")


class _Grid(NamedTuple):
    """What a task needs to place vectors of one length: codebooks, where traversal stops, and each cell's packet."""

    books: tuple[np.ndarray, np.ndarray]
    stop: float
    packet: np.ndarray
    kind: str

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own cell, and the cells after it in number that may hold close vectors.

        Of two close vectors in different cells, the one in the lower cell visits the other's.
        """
        (a, first), (b, second) = (border_bounds(h, c) for h, c in zip(_halves(unit), self.books, strict=True))
        width = len(self.books[1])
        home, visited = a * width + b, []
        for r in range(len(unit)):
            i, j = multi_sequence(first[r], second[r], self.stop)
            cells = i * width + j
            visited.append(cells[cells > home[r]])
        return home, visited


def grid(sample: np.ndarray, per_label: float, threshold: float, recall: float, kind: str = "f8") -> _Grid:
    """The grid for vectors like the sample (of length one), about per_label of which share a label."""
    words = max(LEAST_WORDS, min(MOST_WORDS, round(math.sqrt(per_label / CELL))))
    books = tuple(codebook(h, words if h.shape[1] else 1) for h in _halves(sample))
    first, second = (_squared(h, c).argmin(axis=1) for h, c in zip(_halves(sample), books, strict=True))
    held = np.bincount(first * len(books[1]) + second, minlength=len(books[0]) * len(books[1]))
    packet = (np.cumsum(held) - held) * per_label // (len(sample) * TILE)
    return _Grid(books, stop_bound(sample, books, threshold, recall), packet.astype("i4"), kind)


def _visits(classes: DataFrame, dim: int, plan: _Grid) -> DataFrame:
    """(c, n, label, vec binary, home int, own int, stops array<struct<p, cells>>): a vector's cell and packet, and where it goes.

    Its own packet is among the stops, its own cell first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1_000):
                batch = big.slice(at, 1_000)
                raw = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                home, visited = plan.cells(_unit(raw.astype("f8")))
                ends, packets, cell_ends, cells = [0], [], [0], []
                for own, others in zip(home, visited, strict=True):
                    all_cells = np.concatenate(([own], np.sort(others)))  # so packets rise, the own one first
                    p = plan.packet[all_cells]
                    cuts = np.flatnonzero(np.diff(p)) + 1
                    packets.append(p[np.concatenate(([0], cuts))])
                    cell_ends += (cell_ends[-1] + np.concatenate((cuts, [len(p)]))).tolist()
                    ends.append(ends[-1] + len(cuts) + 1)
                    cells.append(all_cells)
                stops = pa.StructArray.from_arrays([pa.array(np.concatenate(packets), pa.int32()), pa.ListArray.from_arrays(pa.array(cell_ends, pa.int32()), pa.array(np.concatenate(cells), pa.int32()))], ["p", "cells"])
                columns = [batch.column("c"), batch.column("n"), batch.column("label"), pa.array([x.tobytes() for x in raw.astype(plan.kind)], pa.binary()), pa.array(home, pa.int32()), pa.array(plan.packet[home]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stops)]
                yield pa.RecordBatch.from_arrays(columns, ["c", "n", "label", "vec", "home", "own", "stops"])

    label = classes.schema["label"].dataType.simpleString()
    rows = classes.where(F.size("embedding") == dim).select("c", "n", "label", "embedding")
    return rows.mapInArrow(run, f"c long, n long, label {label}, vec binary, home int, own int, stops array<struct<p:int,cells:array<int>>>")


def _inverted(cells: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Rows by the cells that they list."""
    flat = np.concatenate([*cells, np.zeros(0, "i8")]).astype("i8")
    row = np.repeat(np.arange(len(cells)), [len(x) for x in cells])
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    return {int(flat[part[0]]): row[part] for part in np.split(order, cuts) if len(part)}


def _near(a: np.ndarray, b: np.ndarray, left: pd.DataFrame, right: pd.DataFrame, threshold: float, both: bool) -> np.ndarray:
    """Which rows of left and right are close, among those where the one's cell is visited by the other (by right only, unless both)."""
    near = np.zeros((len(a), len(b)), bool)
    for guest, host, across in ((right, left, False), (left, right, True)) if both else ((right, left, False),):
        homes = _inverted([np.array([x]) for x in host["home"]])
        for cell, rows in _inverted(list(guest["cells"])).items():
            if cell in homes:
                x, y = (rows, homes[cell]) if across else (homes[cell], rows)
                near[np.ix_(x, y)] |= a[x] @ b[y].T >= threshold
    return near


def _matches(rows: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Of one tile and what it meets: for each linked row its number of linked vectors here, and its local component's least number."""
    unit = _unit(np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), -1).astype("f8"))
    side = rows["side"].to_numpy()
    left, right = rows[side == 0].reset_index(drop=True), rows[side == 1].reset_index(drop=True)
    a, others = unit[side == 0], unit[side == 1]
    if not len(right):
        near = _near(a, a, left, left, threshold, False)
        near |= near.T
        np.fill_diagonal(near, False)
        return _local(near, left, left, True)
    # Two tiles of one packet visit each other; visitors from elsewhere only visit.
    both = bool((rows["own"] == rows["packet"]).all())
    parts = []
    for at in range(0, len(right), 8_192):
        some = right.iloc[at : at + 8_192].reset_index(drop=True)
        parts.append(_local(_near(a, others[at : at + 8_192], left, some, threshold, both), left, some, False))
    return pd.concat(parts)


def _local(near: np.ndarray, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """(c, links, root) of the linked rows, given which are close."""
    x_all, y_all = left["c"].to_numpy(), right["c"].to_numpy()
    linked, far = near.any(axis=1), near.any(axis=0)
    near = near[linked][:, far]
    x, y, most = x_all[linked], y_all[far], np.iinfo("i8").max
    while near.size:
        # Smallest number by steps over the links, both ways, until nothing changes.
        y2 = np.minimum(y, np.where(near, x[:, None], most).min(axis=0))
        x2 = np.minimum(x, np.where(near, y2[None, :], most).min(axis=1))
        if same:
            y2 = x2
        if np.array_equal(x, x2) and np.array_equal(y, y2):
            break
        x, y = x2, y2
    out = pd.DataFrame({"c": x_all[linked], "links": (near @ right["n"].to_numpy("f8")[far]).astype("i8"), "root": x})
    if same:
        return out
    back = (near.T @ left["n"].to_numpy("f8")[linked]).astype("i8")
    return pd.concat([out, pd.DataFrame({"c": y_all[far], "links": back, "root": y})])


def class_links(classes: DataFrame, threshold: float, recall: float, kind: str = "f8") -> list[DataFrame]:
    """(c, links, root) parts, one DataFrame for each vector length."""
    parts = []
    for dim, n, labels in sorted(tuple(r) for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*"), F.countDistinct("label")).collect()):
        here = classes.where(F.size("embedding") == dim)
        sample = here.orderBy("k", "c").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        plan = grid(_unit(np.stack(sample.to_numpy()).astype("f8")), n / labels, threshold, recall, kind)
        parts.append(_tiles(materialize(_visits(here, dim, plan), "visits"), threshold, kind))
    return parts


def _tiles(visits: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Compare every tile of a packet with the others of its packet and with its visitors."""
    stops = visits.select("label", "own", F.explode("stops.p").alias("p"))
    met = stops.groupBy("label", "p").agg(F.count_if(F.col("own") == F.col("p")).alias("homes"), F.count_if(F.col("own") != F.col("p")).alias("visits"))
    tiles = met.where("homes > 0").select(F.col("label").alias("tl"), F.col("p").alias("tc"), F.ceil(F.col("homes") / TILE).cast("int").alias("th"), F.ceil(F.col("visits") / VISITORS).cast("int").alias("tp"))
    sent = visits.withColumn("h", F.xxhash64("c")).select("label", "c", "n", "vec", "home", "own", "h", F.explode("stops").alias("s")).select("*", "s.p", "s.cells").drop("s")
    placed = sent.join(materialize(tiles, "tiles"), (F.col("label") == F.col("tl")) & (F.col("p") == F.col("tc"))).withColumn("t", F.pmod("h", F.col("th")).cast("int"))
    # A home row meets each tile of its packet (its own included) and each slice of visitors; a visitor meets each tile.
    meeting = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    every_tile = F.sequence(F.lit(0), F.col("th") - 1)
    inner = F.transform(every_tile, lambda u: meeting(F.least("t", u), F.greatest("t", u), F.col("t") > u))
    outer = F.when(F.col("tp") > 0, F.transform(F.sequence(F.lit(0), F.col("tp") - 1), lambda u: meeting(F.col("t"), F.col("th") + u, F.lit(0)))).otherwise(F.array().cast("array<struct<a:int,b:int,side:int>>"))
    guest = F.transform(every_tile, lambda u: meeting(u, F.col("th") + F.pmod("h", F.greatest("tp", F.lit(1))).cast("int"), F.lit(1)))
    meetings = F.when(F.col("own") == F.col("p"), F.concat(inner, outer)).otherwise(guest)
    rows = placed.select("tl", "tc", "c", "n", "vec", "home", "cells", "own", F.col("p").alias("packet"), F.explode(meetings).alias("m")).select("*", "m.a", "m.b", "m.side").drop("m")
    return rows.groupBy("tl", "tc", "a", "b").applyInPandas(lambda pdf: _matches(pdf, threshold, kind), "c long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zero
    rows = vectors.select("vec_id", "label", doubles.alias("embedding"))
    rows = rows.withColumn("k", F.when(_usable(), _key()))
    classes = vector_classes(rows)
    found = None
    for part in class_links(classes, threshold, recall, kind):
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").isNotNull())
    found = materialize(found, "vector-links")
    component = connected_components(found.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"id": "_j", "component": "_root"})
    links = found.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "_i")
    linked = materialize(classes.drop("embedding").join(links, F.col("c") == F.col("_i")).join(component, F.col("c") == F.col("_j")).select("k", "id", "n", "links", "_root"), "vectors-linked")
    least = materialize(linked.groupBy(F.col("_root").alias("_r")).agg(F.min("id").alias("_least")), "vector-components")
    named = linked.join(least, F.col("_root") == F.col("_r")).select("k", "n", "links", F.col("_least").alias("_c"))
    alone = classes.select("k", "n", F.lit(0).cast("long").alias("links"), F.col("id").alias("_c")).join(linked.select("k"), "k", "left_anti")
    named = materialize(named.unionByName(alone).select(F.col("k").alias("_k"), (F.col("n") - 1 + F.col("links")).alias("n_links"), "_c"), "vectors-named")
    joined = rows.select("vec_id", "k").join(named, F.col("k") == F.col("_k"), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
