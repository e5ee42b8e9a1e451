"""The exponent solved independently, and the repetition limit where every document has to be drawn."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import interleave, mixture


def table(spark, sizes, text="one two three"):
    rows = [(i, s, text) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def bisected(good, low=0.0, high=1.0):
    """The border below which good holds, by halves."""
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def weights(shares, a):
    powers = [p**a for p in shares]
    return [x / sum(powers) for x in powers]


def entropy(shares, a):
    return -sum(w * math.log(w) for w in weights(shares, a))


def test_exponent(spark):
    sizes = {"a": 900, "b": 70, "c": 30}
    shares = [n / 1000 for n in sizes.values()]
    df = mixture.source_shares(table(spark, sizes), mixture.word_count(F.col("text")))
    want = bisected(lambda a: entropy(shares, a) >= 0.95 * math.log(3))
    assert mixture.temperature(df, 1.0, 0.95).exponent == pytest.approx(want, abs=1e-6)
    want = bisected(lambda a: max(w / p for w, p in zip(weights(shares, a), shares, strict=True)) > 3.0)
    assert mixture.temperature(df, 1.0, 0.999, 3.0).exponent == pytest.approx(want, abs=1e-6)

    def whole(a):
        """Repetition under the budget that draws each source once at least."""
        rates = [w / p for w, p in zip(weights(shares, a), shares, strict=True)]
        return max(1.0, 1 / min(rates)) * max(rates)

    want = bisected(lambda a: whole(a) > 4.0)
    assert mixture.temperature(df, 1.0, 0.95, 4.0, keep_all=True).exponent == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 70, "c": 30}, {"a": 50, None: 3}, {"a": 10}, {"a": 300, "b": 299, "c": 1}])
def test_redraw_keeps_the_limit(spark, sizes):
    df = table(spark, sizes)
    drawn = Counter(r.doc_id for r in mixture.redraw(df, mixture.word_count(F.col("text")), 0.95, 4.0).select("doc_id").collect())
    assert set(drawn) == set(range(sum(sizes.values()))) and max(drawn.values()) <= 4
    # As often as the blocks say.
    rows = mixture.realise(df, mixture.word_count(F.col("text")), 1.0, 0.95, 4.0, keep_all=True).collect()
    assert sum(drawn.values()) == len(rows) and max(Counter(r.doc_id for r in rows).values()) <= 4
    copies = {s: Counter() for s in sizes}
    for i, s in enumerate(s for s, n in sizes.items() for _ in range(n)):
        copies[s][drawn[i]] += 1
    assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_redraw_of_nulls_and_repeats(spark):
    rows = [(None, "a", None, 1)] * 3 + [(1, "a", "x y", 1)] * 2 + [(1, "a", "z", 1), (None, None, "w w w", 1), (2, "b", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    got = Counter(tuple(r) for r in mixture.redraw(df, mixture.word_count(F.col("text")), 0.95, 4.0).collect())
    assert set(got) == set(rows) and all(n <= 4 * rows.count(r) and n % rows.count(r) == 0 for r, n in got.items())
    blank = table(spark, {"a": 5, "b": 2}, "")
    assert mixture.redraw(blank, mixture.word_count(F.col("text")), 0.95, 4.0).count() == 7


def test_shards_keep_columns_of_their_names(clean_docs, spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    interleave.write(clean_docs.withColumns({"shard": F.lit("mine"), "Slot": F.lit(-1)}), path, 4)
    got = spark.read.parquet(path)
    assert got.where("_shard = 'mine' and _slot = -1").count() == clean_docs.count() and got.where("slot >= 0").count() == clean_docs.count()
