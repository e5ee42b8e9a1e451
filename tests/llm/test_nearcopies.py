import random

import numpy as np
import pytest

from quillspark.llm import nearcopies, simhash

from .conftest import ROWS
from .test_groups import components_of


def near_texts():
    """Texts of 60 to 300 words, each with copies that have a few words changed."""
    rng = random.Random(12)
    out = []
    for base in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(words))
        for _ in range(4):
            edited = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 40))):
                edited[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(edited))
    return out


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("small", [8, 1])
def test_all_pairs_of_the_similarity_are_linked(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    texts = near_texts()
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    hard = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                hard += len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j])
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert hard > 20
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))


def test_one_row_of_each_component(spark, docs, empty):
    rows = [(3, "b one two"), (5, "a text of its own"), (5, "B  one two"), (None, "a lone text"), (None, "a lone text"), (7, "again and again"), (7, "again and again")]
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[3], rows[5]], key=str)
    kept = nearcopies.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i or 0 for i in ids) == [0, 1, 3, 6, 7, 8, 9, 10, 11]
    assert len(ids) == len({" ".join((r[1] or "").lower().split()) for r in ROWS}) and nearcopies.keep_one(empty).count() == 0


def test_keep_first_judges_rows(spark):
    rows = [(3, "b one two"), (5, "a text of its own"), (5, "B  one two")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == rows[:2]


def test_large_groups_keep_their_links(spark, monkeypatch):
    """A crowd around one text, whose groups are cut into slices; brute force over the fingerprints' pairs."""
    monkeypatch.setattr(nearcopies, "GROUP", 40)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + ["other words " + str(i) + " that are alone here" for i in range(30)]
    for _ in range(300):
        edited = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            edited[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(31))


def test_forest_connects_what_may_be_similar():
    rng = np.random.default_rng(5)
    n, width = 65, nearcopies.BANDS * nearcopies.ROWS
    fp = np.concatenate([rng.integers(0, 1 << 63, 3, dtype="u8")[rng.integers(0, 3, 60)] ^ (np.uint64(1) << rng.integers(0, 63, 60).astype("u8")), rng.integers(0, 1 << 63, 5, dtype="u8")])
    marks = rng.integers(0, 256, (4, width), dtype="u1")[rng.integers(0, 4, n)]
    for row in marks:
        row[rng.choice(width, rng.integers(0, 40), replace=False)] = rng.integers(0, 256)
    size = rng.integers(80, 120, n)
    u, v = nearcopies.forest(fp, size, marks, 0.8)

    def may(i, j):
        alike = (marks[i] == marks[j]).sum() >= nearcopies.least_equal(0.8)
        return alike and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and (int(fp[i]) ^ int(fp[j])).bit_count() <= nearcopies.MOST_BITS

    want = components_of(n, [(i, j) for i in range(n) for j in range(i) if may(i, j)])
    assert 1 < len(set(want)) < n and components_of(n, list(zip(u.tolist(), v.tolist(), strict=True))) == want and all(map(may, u, v))
    i, j = np.triu_indices(n, 1)
    sized = np.minimum(size[i], size[j]) >= 0.8 * np.maximum(size[i], size[j])
    assert (nearcopies.may_be_similar(i, j, size, marks, 0.8) == (sized & ((marks[i] == marks[j]).sum(axis=1) >= nearcopies.least_equal(0.8)))).all()


def test_a_pair_at_the_similarity_is_within_the_bits():
    """Random texts with Jaccard similarity near 0.8: hardly any pair differs in more bits than candidates may."""
    rng, gaps = random.Random(8), []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        edited = list(words)
        for k in range(0, len(words), 45):
            edited[k] = "other"
        a, b = plain_shingles(" ".join(words)), plain_shingles(" ".join(edited))
        if len(a & b) >= 0.8 * len(a | b):
            gaps.append((simhash.fingerprint(" ".join(words), 5) ^ simhash.fingerprint(" ".join(edited), 5)).bit_count())
    assert len(gaps) > 100 and max(gaps) <= nearcopies.MOST_BITS


def brute_roots(texts):
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sorted(set(root))


@pytest.mark.parametrize(("group", "most_broadcast"), [(512, 1_000), (3, 0)])
def test_second_round_leaves_no_pair_out(spark, monkeypatch, group, most_broadcast):
    """With no first round at all, the second one finds every link, in whole groups as in those cut into slices."""
    monkeypatch.setattr(nearcopies, "GROUP", group)
    monkeypatch.setattr(nearcopies, "MOST_BROADCAST", most_broadcast)
    monkeypatch.setattr(nearcopies, "candidates", lambda shared, short, similarity: shared.select(shared.c.alias("u"), shared.c.alias("v"), shared.k.alias("g")).limit(0))
    seen, real = [], nearcopies.across
    monkeypatch.setattr(nearcopies, "across", lambda *a: seen.append(real(*a)) or seen[-1])
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts, chain = near_texts()[:60], list(base)
    for _ in range(20):  # a chain whose ends share few shingles, and shorter texts that share a passage only
        chain[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(chain), " ".join([*base[:60], *[f"y{rng.randrange(10**6)}" for _ in range(30)]])]
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == brute_roots(texts) and seen


def test_a_bridge_between_crowds(spark, monkeypatch):
    """Two crowds of close copies with one text in between, which the nearest copies and the tree of a crowd need not reach."""
    monkeypatch.setattr(nearcopies, "GROUP", 16)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(240)]
    moved = [f"v{i}" if 100 <= i < 148 else x for i, x in enumerate(base)]
    between = [f"v{i}" if 100 <= i < 124 else x for i, x in enumerate(base)]
    texts = [" ".join(between)]
    for start in (base, moved):
        for _ in range(40):
            edited = list(start)
            edited[rng.randrange(150, 240)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == brute_roots(texts)


def test_pairs_carry_no_texts(spark):
    """A text goes to each group once, however many pairs it has there, and pairs that are connected already are passed over."""
    same = " ".join(f"w{i}" for i in range(50))
    texts = spark.createDataFrame([(c, same + f" end{c}") for c in range(20)], "c long, t string")
    pairs = spark.createDataFrame([(u, v, u // 10) for u in range(20) for v in range(u + 1, 20) if u // 10 == v // 10], "u long, v long, g long")
    found = nearcopies.verified(pairs, texts, 5, 0.8).collect()
    assert len(found) == 18 and components_of(20, [(r.u, r.v) for r in found]) == [0] * 10 + [10] * 10


def test_repeats_do_not_move_the_bits(spark):
    """Two texts with the same shingles but for a few, one of them repeating a passage 400 times: sets are compared, so they are linked."""
    base, loop = [f"w{i}" for i in range(100)], [f"r{i}" for i in range(5)]
    texts = [" ".join([*base, *loop * 2]), " ".join([*base, *loop * 400])]
    assert brute_roots(texts) == [0]
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def plain_further(text):
    """Further bits of a text, one bit and one shingle at a time."""
    hashes = sorted(nearcopies.shingles(simhash.normal_line(text), 5).tolist())
    most, out = (1 << 64) - 1, []
    for term, factor in zip(nearcopies._TERMS.tolist(), nearcopies._FACTORS.tolist(), strict=True):
        words = []
        for h in hashes:
            x = (h ^ term) * factor & most
            x = (x ^ x >> 32) * factor & most
            words.append(x ^ x >> 29)
        out += [2 * sum(x >> b & 1 for x in words) + (words[0] >> b & 1) * (len(words) == 2) > len(words) for b in range(64)]
    return out


def test_tables_are_blocks_of_simhash_bits():
    texts = ["one", "a few words only and more", "a few words only and more words to it", " ".join(f"w{i}" for i in range(700))]
    words = np.stack([nearcopies.further(nearcopies.shingles(simhash.normal_line(t), 5)) for t in texts])
    keys, marks = nearcopies.band_keys(words), nearcopies.marks_of(words)
    for t, key, mark in zip(texts, keys.tolist(), marks.tolist(), strict=True):
        bits = plain_further(t)
        blocks = [bits[at : at + nearcopies.ROWS] for at in range(0, len(bits), nearcopies.ROWS)]
        assert key == [(n << nearcopies.ROWS) + sum(b << i for i, b in enumerate(block)) for n, block in enumerate(blocks)] and mark == bits


def test_pairs_at_the_similarity_meet():
    """Random texts with Jaccard similarity near 0.8, very short ones among them: all agree in a block and are within the bits; hardly any unlike ones are."""
    rng, near, met = random.Random(4), 0, []
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9 if k % 4 == 0 else rng.randint(60, 200))]
        edited = [*words, "more"] if len(words) == 9 else ["other" if i % 45 == 0 else x for i, x in enumerate(words)]
        a, b = (plain_shingles(" ".join(x)) for x in (words, edited))
        if len(a & b) >= 0.8 * len(a | b):
            sets = [nearcopies.shingles(simhash.normal_line(" ".join(x)), 5) for x in (words, edited)]
            x = np.stack([nearcopies.further(s) for s in sets])
            fp = np.array([simhash.majority(s) for s in sets], "u8")
            near += (nearcopies.band_keys(x)[0] == nearcopies.band_keys(x)[1]).any()
            met.append((fp, x))
            table, one = simhash.pivot_table(fp), np.array([0])
            assert nearcopies._alike(fp, x[:, 0].copy(), table, one, one + 1, 0.8)[0] and (nearcopies.marks_of(x)[0] == nearcopies.marks_of(x)[1]).sum() >= nearcopies.least_equal(0.8)
    assert len(met) > 150 and near == len(met)
    fp, more = np.array([f[0] for f, _ in met]), np.array([x[0, 0] for _, x in met])
    i, j = np.triu_indices(len(met), 1)
    assert nearcopies._alike(fp, more, simhash.pivot_table(fp), i, j, 0.8).mean() < 2e-4


@pytest.mark.parametrize("crowd", [4_096, 5])
def test_local_components(monkeypatch, crowd):
    """Groups of near and unlike fingerprints against all pairs, whether all are compared or those reached already are left out."""
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    rng = np.random.default_rng(2)
    n = 300
    base, of = rng.integers(0, 1 << 63, (6, 2), dtype="u8"), rng.integers(0, 6, n)
    flips = np.packbits(rng.random((n, 128)) < 0.15, axis=1).view("u8")
    fp, more = (base[of] ^ flips).T.copy()
    group = np.sort(np.concatenate((np.zeros(200, "i8"), rng.integers(1, 30, n - 200))))

    def near(i, j):
        a, b = int(fp[i] ^ fp[j]).bit_count(), int(more[i] ^ more[j]).bit_count()
        return group[i] == group[j] and a <= nearcopies.MOST_BITS and a + b <= 128 - nearcopies.least_equal(0.8, 128)

    want = components_of(n, [(i, j) for i in range(n) for j in range(i) if near(i, j)])
    assert 20 < len(set(want)) < n and nearcopies.local_components(group, fp, more, 0.8).tolist() == want


@pytest.mark.parametrize("again", [
    lambda spark, monkeypatch: test_all_pairs_of_the_similarity_are_linked(spark, monkeypatch, 1),
    lambda spark, monkeypatch: test_second_round_leaves_no_pair_out(spark, monkeypatch, 3, 0),
    lambda spark, monkeypatch: test_large_groups_keep_their_links(spark, monkeypatch),
    lambda spark, monkeypatch: test_a_bridge_between_crowds(spark, monkeypatch),
])
def test_what_is_large_takes_two_rounds(spark, monkeypatch, again):
    """The same results when nothing is small enough to be gone through whole."""
    monkeypatch.setattr(nearcopies, "MOST_CLASSES", 0)
    again(spark, monkeypatch)


def test_slices_are_cut_inside_tasks(spark, monkeypatch):
    """A group of two components of 60 classes in slices of 8: its rows are read once, and each pair across comes in one block."""
    monkeypatch.setattr(nearcopies, "GROUP", 8)
    sets = [nearcopies.shingles(simhash.normal_line(" ".join([f"w{i}" for i in range(200)] + [f"end{c}"])), 5) for c in range(60)]
    rows = [(c, simhash.majority(s), len(s), nearcopies.further(s).tobytes()) for c, s in enumerate(sets)]
    short = spark.createDataFrame([(c, c, fp - (fp >> 63 << 64), n, bytearray(x)) for c, fp, n, x in rows], "c long, row long, fp long, size long, sketch binary")
    key = int(nearcopies.band_keys(nearcopies.words_of([x for *_, x in rows]))[0, 0])
    shared = spark.createDataFrame([(1, c, key, 60) for c in range(60)], "k long, c long, first long, n long")
    linked = spark.createDataFrame([(c, c // 50 * 50) for c in range(60)], "id long, component long")
    rest = nearcopies.across(shared, short, spark.createDataFrame([], "u long, v long"), linked, 0.8)
    assert "explode" not in rest._jdf.queryExecution().toString()
    same = {c for c, *_, x in rows if int(nearcopies.band_keys(nearcopies.words_of([x]))[0, 0]) == key}
    blocks = {}
    for r in rest.collect():
        blocks.setdefault(r.g, []).append(r)
    pairs = [(a.c, b.c) for x in blocks.values() for a in x for b in x if a.component < b.component and (a.part != b.part or len({r.part for r in x}) == 1)]
    found = {(a, b) for a in range(50) for b in range(50, 60) if {a, b} <= same}
    assert len(found) > 100 and len(pairs) == len(set(pairs)) and found <= set(pairs)


def test_what_hangs_together_is_gone_through_whole(monkeypatch):
    """Clouds of edited copies, near the similarity: the pairs found connect what all pairs connect, whatever is tried first."""
    rng, texts = random.Random(17), []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            edited = list(base)
            for at in rng.sample(range(120), rng.randint(1, 3)):
                edited[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d"]
    sets = [nearcopies.shingles(simhash.normal_line(t), 5) for t in texts]
    fp, size = np.array([simhash.majority(s) for s in sets], "u8"), np.array([len(s) for s in sets])
    more, plain = np.stack([nearcopies.further(s) for s in sets]), [plain_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
    want = components_of(len(texts), links)
    assert 10 < len(set(want)) < len(texts) - 20
    for nearest in (4, 0):
        monkeypatch.setattr(nearcopies, "NEAREST", nearest)
        pairs = nearcopies.linked_whole(fp, size, more, np.array(texts, object), 5, 0.8)
        assert components_of(len(texts), pairs) == want and len(pairs) == len(texts) - len(set(want))
    fine = nearcopies.fine_components(np.zeros(len(texts), "i8"), fp, size, more, 0.8)
    assert all(fine[i] == fine[j] for i, j in links) and len(set(fine.tolist())) < 12
