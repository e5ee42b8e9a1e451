"""The automaton search against a plain count over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import lexscan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    out = []
    for item, text in items:
        scores = []
        for (doc, count), n in zip(counted, lengths, strict=True):
            score = 0
            for t in set(terms(text)):
                if count[t]:
                    df = sum(c[t] > 0 for _, c in counted)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1_000_000_000 * count[t] // (1000 * count[t] + 20 * (50 + 50 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, i, doc, -score) for i, (score, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, top=50):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, n long, terms long, item long").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, key long")
    return sorted([tuple(r) for r in lexscan.search(d, i, top).collect()], key=str)


@pytest.mark.parametrize("bounds", [{}, {"ITEMS": 3, "CELLS": 40, "HELD": 20, "SAMPLE": 10}])
def test_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexscan, name, value)
    rng = random.Random(1)
    words = ["Über", "über", "ub", "ÜBER", "日本", "日本語", "a", "aa", "A1", "x-y", "don't", "naïve", "\x00", "\x7f", "İ", "K", "🙂", "e", "the"]
    docs = [(i // 2, rng.choice([" ", "\n", "_", "\u00a0", ", "]).join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(120)]
    docs += [(None, "the a"), (None, None), (500, ""), (501, "... !"), (502, "the " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(3, "the"), (None, "a the the"), (90, None), (91, ""), (92, "unseenword")]
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_bounds_of_terms(spark):
    """Only whole terms count, whatever stands around them."""
    docs = [(1, "cat"), (2, "concatenate cats cat-like (CAT)"), (3, "xcat catx"), (4, "cat cat")]
    assert {r[2] for r in run(spark, docs, [(1, "cat")])} == {1, 2, 4}
    key, count = lexscan.counted(lexscan.folded("cat cat CAT,concat cat"), lexscan.automaton([b"dog", b"cat"]))
    assert (key.tolist(), count.tolist()) == ([1], [4])


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], []) == run(spark, [(1, "-"), (2, None)], [(1, "a")])
