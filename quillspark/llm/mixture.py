"""Mixing sources to target weights by temperature.

A source with share p of all tokens gets the weight p^a / sum p^a. The exponent a in [0, 1] is the largest that meets a
target entropy (as a part of the greatest possible one), or else the smallest that keeps every source within a repetition
limit, found by section search on one aggregate a round. Where every document has to be drawn (``keep_all``), the budget is
what gives each source one full block under the exponent in question, so the limit holds for the budget that is used; an
exponent of 1 draws each source once and so meets any limit. Only where the caller's own budget is larger than the limit allows does the
limit yield, to one budget's worth of every source. Weights times the token budget are then laid out in blocks: a
block is one seeded permutation of a source's documents; full blocks take all of them and the last block the first
documents whose tokens begin within what is left of the source's budget.

Positions are exact running counts within (source, block), taken over even slices of the permutation's hash, so a source
with a third of all rows is spread like any other. Null texts have no tokens and are drawn like other documents; a null source
is a source of its own; repeated rows are drawn separately. An empty table gives no rows, and a corpus without a token
uses equal weights and one block.

Tokens are counted in one scan, which leaves short rows; ``redraw`` then needs each source's number of full blocks and the
place where its last block is cut, so the texts themselves are never shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, free_name, hash_buckets, materialize, with_prefix

WAYS, ROUNDS = 16, 8


class Temperature(NamedTuple):
    exponent: float
    normalizer: float
    entropy: float
    repetition: float
    #: Token budget over the corpus's tokens.
    budget: float


def word_count(text: Column) -> Column:
    """Words of a text as a stand-in for tokens, counted without a list of them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def source_shares(docs: DataFrame, tokens: Column) -> DataFrame:
    """(stratum, n_docs, n_tokens, share) per source, written once."""
    sums = docs.groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("n_tokens"))
    sums = materialize(sums, "source-shares")
    total = sums.agg(F.sum("n_tokens")).first()[0] or 0
    return sums.withColumn("share", F.col("n_tokens") / F.lit(total) if total else F.lit(0.0))


def temperature(shares: DataFrame, budget_ratio: float = 1.0, target_entropy: float | None = None, max_repetition: float | None = None, keep_all: bool = False) -> Temperature:
    """The exponent: the largest that reaches target_entropy * ln(sources), raised as far as max_repetition asks.

    budget_ratio is the token budget over the corpus's tokens; with keep_all it grows to one full block of every source. Entropy falls
    and the largest repetition of a source (its weight times the budget over its tokens) falls too as the exponent rises, so
    both ends are found by sections.
    """
    present = shares.where("share > 0")

    def measure(exponents: list[float]) -> list[Temperature]:
        def sums(a: float) -> Column:
            power = F.pow("share", F.lit(a))
            return F.struct(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("pl"), F.max(F.pow("share", F.lit(a - 1))).alias("most"), F.min(F.pow("share", F.lit(a - 1))).alias("least"))

        row = present.agg(*[sums(a).alias(f"m{i}") for i, a in enumerate(exponents)]).first()
        budgets = [max(budget_ratio, m.z / m.least) if keep_all else budget_ratio for m in row]
        return [Temperature(a, m.z, math.log(m.z) - a * m.pl / m.z, b * m.most / m.z, b) for a, m, b in zip(exponents, row, budgets, strict=True)]

    n = present.count()
    if n == 0:
        return Temperature(1.0, 1.0, 0.0, budget_ratio, budget_ratio)

    def section(good, low: float, high: float) -> tuple[float, float]:
        """Two close points of [low, high], good holding at the first and failing at the second, or (high, high)."""
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / WAYS for i in range(WAYS + 1)]
            fine = [good(m) for m in measure(points)]
            if all(fine):
                return high, high
            last = fine.index(False) - 1
            low, high = points[max(last, 0)], points[last + 1]
        return low, high

    exponent = 1.0
    if target_entropy is not None:
        goal = min(target_entropy, 1.0 - 1e-12) * math.log(n)
        exponent = section(lambda m: m.entropy >= goal, 0.0, 1.0)[0]
    if max_repetition is not None and measure([exponent])[0].repetition > max(max_repetition, budget_ratio):
        exponent = section(lambda m: m.repetition > max(max_repetition, budget_ratio), exponent, 1.0)[1]
    return measure([exponent])[0]


class _Layout(NamedTuple):
    """Short rows (_stratum, _key, n_tokens and kept columns) and each source's blocks (_s, weight, _full, _left)."""

    rows: DataFrame
    blocks: DataFrame


def _layout(rows: DataFrame, budget_ratio: float, target_entropy: float | None, max_repetition: float | None, keep_all: bool) -> _Layout:
    rows = materialize(rows, "mixture-rows")
    sums = materialize(rows.groupBy("_stratum").agg(F.sum("n_tokens").alias("n_tokens")), "source-shares")
    total = sums.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("n_tokens") / F.lit(total) if total else F.lit(0.0))
    found = temperature(shares, budget_ratio, target_entropy, max_repetition, keep_all)
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(found.exponent)) / F.lit(found.normalizer)).otherwise(F.lit(0.0))
    quota = F.floor(weight * F.lit(float(total * found.budget)) + F.lit(1e-6)).cast("long")
    if max_repetition is not None:  # sums of doubles may end a few tokens beyond the limit or short of a block
        quota = F.least(quota, F.floor(F.col("n_tokens") * F.lit(float(max(max_repetition, budget_ratio)))).cast("long"))
    if keep_all:
        quota = F.greatest(quota, "n_tokens")
    blocks = shares.select(F.col("_stratum").alias("_s"), weight.alias("weight"), F.col("n_tokens").alias("_all"), quota.alias("_quota"))
    full = F.when(F.col("_all") > 0, F.expr("_quota div _all")).otherwise(F.lit(1))
    left = F.when(F.col("_all") > 0, F.expr("_quota % _all")).otherwise(F.lit(0))
    return _Layout(rows, blocks.select("_s", "weight", full.cast("int").alias("_full"), left.alias("_left")))


def _order_hash(seed: int, block: Column | str) -> Column:
    """Where a document stands in a block's permutation."""
    return F.xxhash64(F.lit(seed), block, "_key")


def _placed(drawn: DataFrame, seed: int, n: int) -> DataFrame:
    """drawn (with _stratum, block, _key, n_tokens) and exact _rank and _before in each block's permutation."""
    hashed = drawn.withColumn("_h", _order_hash(seed, "block"))
    return with_prefix(hashed, ["_stratum", "block"], hash_buckets("_h", bucket_bits(n)), ["_h", "_key", "n_tokens"], F.col("n_tokens"))


def realise(docs: DataFrame, tokens: Column, budget_ratio: float = 1.0, target_entropy: float | None = None, max_repetition: float | None = None, seed: int = 29, keep_all: bool = False) -> DataFrame:
    """One row per draw: (doc_id, source, n_tokens, weight, block, slot, start).

    ``slot`` and ``start`` are the documents and tokens before it in its block's permutation. With ``keep_all`` the
    budget is raised, if need be, to what gives every source one full block, so that mixing loses no document.
    """
    rows, blocks = _layout(docs.select(F.col("doc_id").alias("_key"), "source", _stratum().alias("_stratum"), tokens.alias("n_tokens")), budget_ratio, target_entropy, max_repetition, keep_all)
    drawn = (
        rows.join(blocks, F.col("_stratum") == F.col("_s"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_full"))))
        .where((F.col("block") < F.col("_full")) | (F.col("_left") > 0))
    )
    placed = _placed(drawn, seed, rows.count())
    return placed.where((F.col("block") < F.col("_full")) | (F.col("_before") < F.col("_left"))).select(
        F.col("_key").alias("doc_id"), "source", "n_tokens", "weight", "block", F.col("_rank").alias("slot"), F.col("_before").alias("start")
    )


def redraw(docs: DataFrame, tokens: Column, target_entropy: float, max_repetition: float, seed: int = 29) -> DataFrame:
    """docs as often as the mixture draws them, every one at least once, copies next to each other.

    A document's place in a permutation comes from doc_id and text, so rows that are equal in both are drawn alike.
    """
    key = F.xxhash64("doc_id", "text")
    rows, blocks = _layout(docs.select(key.alias("_key"), _stratum().alias("_stratum"), tokens.alias("n_tokens")), 1.0, target_entropy, max_repetition, keep_all=True)
    partial = rows.join(blocks.where("_left > 0").withColumnRenamed("_full", "block"), F.col("_stratum") == F.col("_s"))
    inside = _placed(partial, seed, rows.count()).where("_before < _left")
    cut = inside.groupBy("_stratum").agg(F.max(F.struct("_h", "_key")).alias("_cut")).withColumnRenamed("_stratum", "_c")
    plan = blocks.join(cut, F.col("_s") == F.col("_c"), "left").select("_s", "_full", "_cut")
    names = {c: free_name(c[1:], docs.columns) for c in ("_s", "_full", "_cut")}
    plan = materialize(plan.withColumnsRenamed(names), "mixture-plan")
    s, full, last = (F.col(names[c]) for c in ("_s", "_full", "_cut"))
    h = F.xxhash64(F.lit(seed), full, key)
    drawn = full + F.when(F.struct(h.alias("_h"), key.alias("_key")) <= last, 1).otherwise(0)
    copies = F.explode(F.sequence(F.lit(1), drawn)).alias(free_name("copy", docs.columns))
    return docs.join(plan, _stratum() == s).select(*docs.columns, copies).select(docs.columns)
