import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, multiindex, simhash

from .conftest import ROWS


def components_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(1)
    n = 60
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(0, n - 1, 2)], "none": []}[shape]
    rng.shuffle(edges)
    found = common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = components_of(n, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(tuple(r) for r in found) == sorted((i, want[i]) for i in touched)


def test_edges_of_shared_hubs_are_drawn_together_before_they_are_doubled(spark, monkeypatch):
    """Ids in many groups, each with an edge to each group's hub: only about a tree's edges are taken in both directions."""
    written, doubled, plain = [], [], common.materialize

    def told(df, label):
        if "explode" in df._jdf.queryExecution().toString() and label == "lows":
            doubled.append(written[-1])
        out = plain(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", told)
    edges = [(20 + i, (i * 7 + k) % 20) for i in range(100) for k in range(12)]
    found = common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0) for i in range(120)]
    assert doubled and max(doubled) < 300 < len(set(edges))


def test_prefix(spark):
    rows = [(k, h, v) for k, n in (("a", 40), ("b", 3)) for h, v in ((random.Random(k + str(i)).randrange(-(1 << 63), 1 << 63), i) for i in range(n))]
    df = spark.createDataFrame(rows, "k string, h long, v long")
    got = common.with_prefix(df, ["k"], common.hash_buckets("h", 3), ["h"], F.col("v")).collect()
    for key in "ab":
        before, ordered = 0, sorted((h, v) for k, h, v in rows if k == key)
        for rank, (h, v) in enumerate(ordered):
            r = next(x for x in got if x.k == key and x.h == h)
            assert (r._rank, r._before, r._key_rows) == (rank, before, len(ordered))
            before += v


def plain_fingerprint(text):
    import re

    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [r[1] for r in ROWS if r[1] is None or len(r[1]) < 1000] + ["a b c", "a b c d", "Ä Ö\x0bü x Y\x1cz"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_xxhash64_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_simhash_components(spark, docs, empty):
    rows = {(r.doc_id, r.component_id) for r in simhash.components(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 9), (10, 10)} <= rows and len(simhash.components(docs).collect()) == len(ROWS)
    assert simhash.components(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert 1 in kept and 2 not in kept and 4 not in kept and None in kept and kept.count(9) == 2


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def brute(fps, distance=4):
    edges = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= distance]
    return components_of(len(fps), edges)


@pytest.mark.parametrize("tight", [False, True])
def test_links_lose_nothing(spark, monkeypatch, tight):
    """Random fingerprints with planted neighbours, and a crowded group, also when groups are cut again."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [flipped(rng, rng.choice(fps), rng.randint(1, 7)) for _ in range(300)]
    if tight:
        centre = rng.getrandbits(64)
        fps += [flipped(rng, centre, rng.randint(0, 5)) for _ in range(500)]
        monkeypatch.setattr(simhash, "GROUP_LIMIT", 50)
    fps = sorted(set(fps))
    rng.shuffle(fps)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.id: r.component for r in common.connected_components(simhash.links(classes)).collect()}
    want = brute(fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_large_groups_split_in_the_task(monkeypatch):
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 30, 6000, dtype="u8"))
    u, v = simhash._large_group(fp, simhash.pivot_table(fp), 4, ((1 << 64) - 1) ^ ((1 << 30) - 1))
    near = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4)[:50] + i + 1]
    want = components_of(len(fp), near) if len(near) < 200_000 else None
    root = simhash._stars(u.copy(), v.copy(), len(fp))
    if want is not None:
        assert root.tolist() == want


def test_pivots_never_discard_a_link():
    rng = random.Random(5)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = flipped(rng, a, rng.randint(0, 4))
        table = simhash.pivot_table(np.array([a, b], "u8")).astype(int)
        assert np.abs(table[0] - table[1]).max() <= 4


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 16))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    for i in range(200, 420):  # neighbours around the threshold, and a crowd around vector 0
        of = base[0] if i % 2 else base[rng.integers(200)]
        rows.append((i, (of + rng.normal(size=16) * rng.uniform(0, 0.35)).tolist(), 0 if i % 2 else int(rng.integers(3))))
    rows += [(500, rows[7][1], 1), (501, rows[7][1], 1), (502, [3 * x for x in rows[7][1]], 1), (503, rows[7][1], 2)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] * 16, 0), (604, rows[0][1], None), (605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0), (607, [float("inf")] + [1.0] * 15, 0)]
    rows += [(608, [1.0], 0), (609, [5.0], 0), (610, [-1.0], 0)]
    return rows


@pytest.mark.parametrize("recall", [1.0, 0.999])
def test_multi_index(spark, monkeypatch, recall):
    monkeypatch.setattr(multiindex, "CELL", 8)
    monkeypatch.setattr(multiindex, "TILE", 16)
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"n_links": F.lit(9), "id": F.lit(8), "n": F.lit(7)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_duplicates(df, 0.98, recall).collect()}

    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    edges = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            _, b, lb = rows[j]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    edges.append((i, j))
    root = components_of(len(rows), edges)
    links = np.bincount(np.array(edges).ravel(), minlength=len(rows))
    want = {r[0]: (int(links[i]), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    if recall == 1.0:
        assert got == want
    else:
        assert sum(v[0] for v in got.values()) >= 0.99 * links.sum()


def test_multi_index_repeats_and_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multiindex.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    none = multiindex.near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], schema)).collect()
    assert {(r.vec_id, r.n_links) for r in none} == {(1, 0), (None, 0)}
    twice = multiindex.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], schema)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 1, True)] * 2


def test_traversal_is_sorted_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.random(20), rng.random(30)
    i, j = multiindex.multi_sequence(a, b, 0.7)
    sums = a[i] + b[j]
    assert (np.diff(sums) >= 0).all() and set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(20) for y in range(30) if a[x] + b[y] <= 0.7}
