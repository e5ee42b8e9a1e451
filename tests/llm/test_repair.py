"""Conversation repair against a search over all edits, and its defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspark.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Rows after damage, in order, of one conversation."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit, repaired lines): rows one by one, all ways kept that end in a different list of roles' last two and first."""
    ways = {("", 0): (0, "", ())}
    legal = re.compile(r"s?(ua)*u?")

    def better(found, key, way):
        if key not in found or way[:2] < found[key][:2]:
            found[key] = way

    def widened(ways):
        found = dict(ways)
        for _ in range(3):
            for (roles, n), (cost, audit, lines) in list(found.items()):
                for name in ("user", "assistant"):
                    new = roles + name[0]
                    if legal.fullmatch(new):
                        better(found, (new[:1] + new[-1] if len(new) > 2 and new[0] != "s" else shorter(new), n), (cost + 2, audit + "I", (*lines, f"{name}:")))
        return found

    def shorter(roles):
        start, rest = ("s", roles[1:]) if roles[:1] == "s" else ("", roles)
        return start + rest[: 2 + len(rest) % 2] if len(rest) > 3 else roles

    for n, ((_, role, text), mark) in enumerate(zip(rows, marks, strict=True), 1):
        found = {}
        for (roles, _), (cost, audit, lines) in widened({(shorter(r), i): w for (r, i), w in ways.items()}).items():
            better(found, (roles, n), (cost + 3, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            more = mark == "truncated"
            for name, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                if legal.fullmatch(roles + name[:1]) and name:
                    better(found, (shorter(roles + name[:1]), n), (cost + price + more, audit + letter, (*lines, f"{name}:{text}")))
        ways = found
    ends = [w for (roles, _), w in widened(ways).items() if re.fullmatch(r"(s?(ua)+)?", roles)]
    return min(ends, key=lambda w: w[:2])


def expected(convs):
    out = {}
    for conv in {r[0] for r in convs}:
        rows = damaged([r for r in convs if r[0] == conv])
        marks, turns = faults(rows), {r[0] for r in rows} - {None}
        cost, audit, lines = cheapest(rows, marks)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, convs):
    df = spark.createDataFrame(convs, "conv_id long, turn long, role string, text string").repartition(3)
    rows = repair.report(repair.damage(df)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.mark.parametrize("block", [2, 128])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(3)
    says = ["Hello.", "Why?", "no stop", "", " \t", "Yes!", "Fine. \n", "x", None]
    convs = [
        (conv, None if rng.random() < 0.05 else turn + (turn > 4), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(says))
        for conv in range(60)
        for turn in range(rng.randrange(1, 12))
    ]
    convs += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (7_000, 1, "user", "Same."), (7_000, 1, "user", "Same.")]
    assert found(spark, convs) == expected(convs)


def test_long_conversation(spark):
    """A conversation of many blocks, some of whose values never become one."""
    convs = [(1, t, "system" if t % 7 else "user", f"row {t}.") for t in range(700)] + [(2, t, "user" if t % 2 else "assistant", f"row {t % 300}") for t in range(900)]
    assert found(spark, convs) == expected(convs)


def test_all_dropped_and_empty(spark):
    gone = next(t for t in range(1_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found(spark, [(5, gone, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_clashing_columns_and_rows(spark):
    """Extra columns named as the operator's own don't matter, and the repaired rows are real."""
    rows = [(1, 1, "user", "Why?"), (1, 2, "user", "Because."), (1, 3, "assistant", "So it is."), (1, 4, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "conv_id long, turn long, role string, text string, place long, said string, fault string, cost long")
    judged = repair.judged(df)
    out = repair.repaired(judged, repair.audits(judged)).orderBy("number").collect()
    assert [(r.number, r.edit, r.turn, r.role, r.text) for r in out] == [(1, "K", 1, "user", "Why?"), (2, "I", None, "assistant", ""), (3, "K", 2, "user", "Because."), (4, "K", 3, "assistant", "So it is.")]


def test_agenda_order():
    """Goals come by cost, then by audit; an item once final stays so."""
    graph = {"a": [("b", 1, "X"), ("c", 0, "B"), ("c", 0, "A")], "c": [("b", 1, "A")], "b": [("a", 0, "K")]}
    popped = []

    def deduce(item, final):
        popped.append(item)
        return [(to, (final[item][0] + c, final[item][1] + x)) for to, c, x in graph[item]]

    assert repair.lightest({"a": (0, "")}, deduce, ["b", "c", "none"]) == {"a": (0, ""), "c": (0, "A"), "b": (1, "AA")}
    assert popped == ["a", "c", "b"]
