"""The grid at production sizes, and classes without an id."""

import numpy as np
import pytest

from quillspark.llm import multiindex


def unit(rng, n, dim=32, spread=1.0):
    x = rng.normal(size=(n, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_traversal_visits_fewer_cells_than_there_are():
    sample = unit(np.random.default_rng(1), 500)
    plan = multiindex.grid(sample, 50.0, 0.98, 1.0)
    cells = len(plan.books[0]) * len(plan.books[1])
    home, visited = plan.cells(sample)
    assert cells >= 200 and len(np.unique(home)) > 50
    assert 0 < np.mean([len(v) for v in visited]) < cells / 2
    close = sample + 0.02 * unit(np.random.default_rng(2), 500)
    close /= np.linalg.norm(close, axis=1, keepdims=True)
    there, back = plan.cells(close)
    for a, b, va, vb in zip(home, there, visited, back, strict=True):
        assert a == b or b in va or a in vb


@pytest.mark.parametrize("tile", [8_192, 64])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, monkeypatch, tile, kind):
    monkeypatch.setattr(multiindex, "TILE", tile)
    monkeypatch.setattr(multiindex, "VISITORS", tile)
    rng = np.random.default_rng(4)
    x = unit(rng, 700)
    x[400:] = x[rng.integers(0, 40, 300)] + rng.uniform(0, 0.06, (300, 1)) * unit(rng, 300)
    x = x.astype("f4").astype("f8")
    label = rng.integers(0, 2, 700)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (y @ y.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = np.arange(700)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], 700).min(axis=1))
        if np.array_equal(new, root):
            break
        root = new
    assert near.sum() > 500 and got == {i: (int(near[i].sum()), int(root[i])) for i in range(700)}


def test_vectors_without_an_id_count_as_links(spark):
    rows = [(1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [1.0, 0.01], 0), (2, [1.0, 0.02], 0), (None, [0.0, 1.0], 0), (3, [-0.0, 5.0, 0.0], 1), (4, [0.0, 5.0, -0.0], 1)]
    got = multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted(
        [(1, 3, 1, True), (0, 3, 1, False), (0, 3, 1, False), (2, 3, 1, False), (0, 0, 0, False), (3, 1, 3, True), (4, 1, 3, False)]
    )
