"""Surrogates over a corpus, against a plain-Python version with the same draws, and by the places where they stand."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import surrogates

KEY = b"k"
DRAW = surrogates.draw


def narrow(key, kind, spelling, gender, attempt):
    """Draws with so few outcomes that many collide, with each other and with entities."""
    place = sum(map(ord, spelling + gender))
    if kind == "name":
        return " ".join(f"{gender}{'bdf'[(place + attempt) % 3]}o{attempt}" if i == 0 else w[::-1] for i, w in enumerate(spelling.split(" ")))
    if kind == "domain":
        return f"d{(place + attempt) % 5 + 5 * attempt}.example"
    return f"12345{(place + 7 * attempt) % 90:04d}" if kind == "ssn" else DRAW(key, kind, spelling, gender, attempt)


def plain(texts, draw):
    """What replace has to give: rounds over all distinct entities, first by spelling and gender."""
    entity = {e for x in texts for e in surrogates.held(x)}
    taken, waiting, chosen = {(k, s) for k, s, _ in entity}, set(entity), {}
    attempt = 0
    while waiting:
        groups = defaultdict(list)
        for e in waiting:
            groups[e[0], draw(KEY, *e, attempt)].append(e)
        for place, group in groups.items():
            if place not in taken:
                chosen[min(group)] = place[1]
        taken |= {(e[0], chosen[e]) for e in waiting if e in chosen}
        waiting = {e for e in waiting if e not in chosen}
        attempt += 1
    assert attempt > 2
    return [(x, 0) if x is None else surrogates.rewritten(x, lambda *e: chosen[e]) for x in texts], chosen


TEXTS = [
    *[f"Mr{'s' * (i % 2)} {'ABCD'[i % 4]}nna {'Berg Gerb Lund'.split()[i % 3]} and {'ABCD'[i % 4]}nna called 123-45-{i % 17:04d}, mail u{i}@h{i % 9}.org or u{i}@H{i % 4}.net." for i in range(40)],
    "Dr Anna Berg and Mrs Anna Berg; BERG said so.",
    "",
    None,
    "no one",
    "123-45-0001",
]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_plain_python(spark, monkeypatch, kind):
    monkeypatch.setattr(surrogates, "draw", narrow)
    ids = [i if i % 5 else None if i % 10 else 7 for i in range(len(TEXTS))]
    df = spark.createDataFrame(list(zip(ids, range(len(TEXTS)), TEXTS, strict=True)), "doc_id long, moved int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    want, chosen = plain(TEXTS, narrow)
    assert len({(k, s) for (k, _, _), s in chosen.items()}) == len(chosen)
    for bound in (0, 10**6):
        got = {r.moved: (r.text, r.n_entities) for r in surrogates.replace(df, KEY, bound).collect()}
        assert [got[i] for i in range(len(TEXTS))] == want


def new(text):
    return surrogates.rewritten(text, lambda *e: DRAW(KEY, *e, 0))[0]


def test_later_mentions():
    words = new("Mr. John Smith met us. Smith said hello; John Smith left, SMITH too. Blacksmith stayed. Mr Smith").split()
    given, family = words[1], words[2]
    assert words[5] == family and words[8:10] == [given, family] and words[11] == family.upper() and words[13] == "Blacksmith" and words[16] == family
    assert new("my name is Anna Berg. Berg left") == new("my name is Anna Berg. Berg left") and "Berg" not in new("my name is Anna Berg. Berg left")


def test_gender_counts():
    a, b = re.fullmatch("Mrs (.+) and Mr (.+)", new("Mrs Smith and Mr Smith")).groups()
    assert a != b
    a, b = re.fullmatch(r"Dr (\w+) \w+ met Mrs (\w+) \w+", new("Dr Anna Berg met Mrs Anna Berg")).groups()
    assert a == b and a.endswith("a")


@pytest.mark.parametrize("number, kept", [("+49 30 1234567", "+49 "), ("+81 3 1234 5678", "+81 "), ("+358 9 1234 567", "+358 "), ("+7 495 123-45-67", "+7 "), ("+1 (017) 555-7713", "+1 (")])
def test_calling_codes_stay(number, kept):
    text = new(f"call {number}, please")[5:-8]
    assert text.startswith(kept) and text != number and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", number)


def test_valid_account_numbers_stay_valid():
    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    for number in ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"):
        assert valid(number) and valid(new(number)) and new(number) != number and new(number)[:2] == number[:2]
    assert not valid("DE88 3704 0044 0532 0130 00")


def test_any_length():
    for secret in ("sk-" + "a1" * 120, "f0" * 128):
        assert secret not in new(f"a {secret} b") and len(new(secret)) == len(secret)
    text = new('password = "' + "xY9" * 100 + '" end')
    assert "xY9" * 3 not in text and text.endswith('" end')
    address = "l" * 300 + "@" + "d" * 200 + ".org"
    assert "lll" * 9 not in new(address) and "ddd" * 9 not in new(address)
    assert "Quux" not in new("Dr Foo Bar Baz Quux said")


def test_domains_stay_distinct(spark):
    rows = [(i, f"x@{c}.org y@{c}.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    found = [re.findall(r"@(\S+)", r.text) for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string"), KEY).collect()]
    assert all(a == b for a, b in found) and len({a for a, _ in found}) == 26
