"""Conversation structure repair by Knuth's lightest-derivation agenda.

The roles of a whole conversation, by their initials, form ``(s?(ua)+)?``: nothing, or user and assistant in turns, behind at most
one system row. What is derived is an item (rows read, state of that pattern); every edit is a deduction from one item to the next
with a superior function of its antecedent's value (cost, audit): it adds the edit's cost and appends the edit's initial. The agenda
pops items in order of that value, so each is final when popped (``lightest``), until the goal items are.

* Values are compared by cost, then by audit in ASCII order. Two derivations of one item that cost the same read the same rows, so neither
  audit begins with the other and the order survives whatever is appended: the functions are monotone.
* Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only edit of a blank or a repeated row), Insert of an empty user or
  assistant row 2; a row that ends without a stop and isn't deleted adds 1.

A conversation is cut into blocks of ``BLOCK`` rows, whose items are derived apart from each other, each block in any task: the first from
the empty conversation, others from every state. The blocks' results are again items of deductions with two antecedents each (all
up to here, and this block), folded in one short row a block. So no task holds a long conversation; its audit, one letter an edit, is
part of the result, and its rows are repaired one by one in order. A digest over all rows of a conversation can only be taken in
their order, by one task, which streams them.

Nulls: a null role or text is one space (a role that has to be changed, a blank text); null turns come first; null conv_ids are one
conversation. Rows that tie in turn are ordered by role and text, and rows repeated as a whole are adjacent, the later ones duplicates. An
empty text is blank. Long texts are never held together. An empty table gives an empty result. Only conv_id, turn, role and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os.path
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialize

#: Rows of a conversation whose repair is derived at once.
BLOCK = 128
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: What the pattern of roles allows: state -> initial -> next state.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
WORDLESS, OPEN_END = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"

Value = tuple[int, str]


def lightest(axioms: dict[Hashable, Value], deduce: Callable[[Hashable, dict], Iterable[tuple[Hashable, Value]]], goals: Iterable[Hashable]) -> dict:
    """The least value of every goal that can be derived. ``deduce`` gives the conclusions that an item has together with items final before."""
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final: dict[Hashable, Value] = {}
    wanted = set(goals)
    while agenda and wanted:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        wanted.discard(item)
        for head, worth in deduce(item, final):
            if head not in final:
                heapq.heappush(agenda, (worth, head))
    return final


def edits(state: int, initial: str, fault: str) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, audit) of what may be done with one row."""
    yield state, DELETE, "D"
    if fault in ("blank", "duplicate"):
        return
    more = UNFINISHED * (fault == "truncated")
    if initial in NEXT[state]:
        yield NEXT[state][initial], KEEP + more, "K"
    for role in NAMES:
        if role in NEXT[state]:
            yield NEXT[state][role], REROLE + more, "R"


def block_values(rows: list[tuple[str, str]], state: int) -> dict[int, Value]:
    """The lightest repair of some rows (initial, fault) that leads from a state to each other one."""

    def deduce(item: tuple[int, int], final: dict) -> Iterator[tuple[tuple[int, int], Value]]:
        (read, at), (cost, audit) = item, final[item]
        for role in NAMES:
            if role in NEXT[at]:
                yield (read, NEXT[at][role]), (cost + INSERT, audit + "I")
        if read < len(rows):
            for to, worth, letter in edits(at, *rows[read]):
                yield (read + 1, to), (cost + worth, audit + letter)

    final = lightest({(0, state): (0, "")}, deduce, [(len(rows), q) for q in NEXT])
    return {q: final[len(rows), q] for q in NEXT if (len(rows), q) in final}


def joined(before: dict[int, Value], block: dict[tuple[int, int], Value]) -> dict[int, Value]:
    """The lightest values after a block, from those before it and the block's own: deductions with two antecedents each."""
    pushed = {("before", q): v for q, v in before.items()}

    def deduce(item: tuple, final: dict) -> Iterator[tuple[tuple, Value]]:
        if item[0] == "before":
            cost, audit = final[item]
            for (p, q), (worth, letters) in block.items():
                if p == item[1]:
                    yield ("after", q), (cost + worth, audit + letters)

    final = lightest(pushed, deduce, [("after", q) for q in NEXT])
    return {q: final["after", q] for q in NEXT if ("after", q) in final}


def whole_value(values: dict[int, Value]) -> Value:
    """The goal: the least of the values that end in a complete pattern."""
    return min(values[q] for q in FINAL if q in values)


def damage(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of convs, damaged by the checksum of conv_id and turn: dropped rows are marked gone, emptied, stripped
    of stops, repeated, or given to the user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = convs.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1)))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") == 0).alias("gone"), copies.alias("_c")).drop("_c")


def judged(rows: DataFrame) -> DataFrame:
    """Written rows (conv_id, turn, role, text, place, initial, illegal, fault): every row's place in its conversation and first fault."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(order)
    placed = rows.select(
        "*",
        F.row_number().over(order).cast("long").alias("place"),
        initial.alias("initial"),
        (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).alias("illegal"),
        F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("said"),
    )
    placed = materialize(placed, "placed-rows")
    first = placed.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    fault = F.when(F.col("text").rlike(WORDLESS), "blank").when(F.col("place") > F.col("_first"), "duplicate").when(~F.col("text").rlike(OPEN_END), "truncated").otherwise("")
    return materialize(marked.withColumn("fault", fault).drop("_conv", "_said", "_first", "said"), "judged-rows")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of batches, in order, by runs of equal keys; a run is read as it is asked for, and may be longer than a batch."""
    rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in [*keys, *values]], strict=True))
    n = len(keys)
    for key, run in itertools.groupby(rows, key=lambda row: row[:n]):
        yield key, (row[n:] for row in run)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of the lightest repair of every conversation of judged rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    block_schema = f"conv_id {kind}, block long, start array<int>, end array<int>, cost array<long>, audit array<string>"

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), run in _groups(batches, ["conv_id", "block"], ["initial", "fault"]):
            part = list(run)
            found = [(p, q, *value) for p in (NEXT if block else (0,)) for q, value in block_values(part, p).items()]
            start, end, cost, audit = (list(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.nulls(1) for x in (conv, block, start, end, cost, audit)], ["conv_id", "block", "start", "end", "cost", "audit"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), run in _groups(batches, ["conv_id"], ["start", "end", "cost", "audit"]):
            values, done = {0: (0, "")}, []
            for start, end, cost, audit in run:
                values = joined(values, {(p, q): (c, a) for p, q, c, a in zip(start, end, cost, audit, strict=True)})
                # What all values begin with is settled: it needs neither comparing nor copying any more.
                texts = [a for _, a in values.values()]
                same = len(os.path.commonprefix(texts))
                if same:
                    done.append(texts[0][:same])
                    values = {q: (c, a[same:]) for q, (c, a) in values.items()}
            cost, rest = whole_value(values)
            yield pa.RecordBatch.from_arrays([pa.array([conv]) if conv is not None else pa.nulls(1), pa.array([cost]), pa.array(["".join(done) + rest])], ["conv_id", "cost", "audit"])

    short = rows.select("conv_id", F.expr(f"(place - 1) div {BLOCK}").alias("block"), "place", "initial", "fault")
    blocks = short.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_typed(derive, block_schema), block_schema)
    whole = f"conv_id {kind}, cost long, audit string"
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_typed(fold, whole), whole)


def _typed(run: Callable, schema: str) -> Callable:
    """run with its batches of single rows gathered into larger ones of the schema's types."""
    fixed = to_arrow_schema(StructType.fromDDL(schema))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(batches)
        while part := list(itertools.islice(made, 1_000)):
            yield from pa.Table.from_batches([b.cast(fixed) for b in part]).combine_chunks().to_batches()

    return gathered


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, number, edit, turn, role, text) of the repaired conversations of judged rows by their audits, deleted rows left out.

    The rows of a conversation are adjacent and in order. Inserted rows have no turn.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    schema = f"conv_id {kind['conv_id']}, number long, edit string, turn {kind['turn']}, role string, text string"
    plans = found.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast(kind["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    together = plans.unionByName(rows.select("conv_id", "place", "turn", "role", "text"))

    fixed = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, fixed, strict=True)], schema=fixed)

        for (conv,), lines in _groups(batches, ["conv_id"], ["turn", "role", "text"]):
            audit, state, number = next(lines)[2], 0, 0
            for letter in audit:
                turn, role, text = (None, "", "") if letter == "I" else next(lines)
                if letter == "D":
                    continue
                if letter != "K":
                    role = NAMES["a" if state == 2 else "u"]
                state = NEXT[state][role[0]]
                number += 1
                out.append((conv, number, letter, turn, role, text))
                held += len(text)
                if len(out) >= 1_000 or held > 4_000_000:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return together.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows, in the order in which ``repaired`` leaves them: each conversation's rows are streamed."""
    schema = f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _groups(batches, ["conv_id"], ["role", "text"]):
            digest = hashlib.sha256()
            for i, (role, text) in enumerate(rows):
                digest.update((f"\n{role}:{text}" if i else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([conv]) if conv is not None else pa.nulls(1), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return lines.mapInArrow(_typed(run, schema), schema)


def summary(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) of judged rows."""
    counts = [F.sum((F.col("fault") == x).cast("long")).alias(x) for x in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return rows.groupBy("conv_id").agg(gaps.alias("gaps"), *counts, F.sum(F.col("illegal").cast("long")).alias("illegal"))


def report(convs: DataFrame) -> DataFrame:
    """The measures, audit and digest of every conversation of convs as it is, rows marked ``gone`` (if there is such a column) left out."""
    present = convs.where(~F.col("gone")) if "gone" in convs.columns else convs
    rows = judged(present)
    found = materialize(audits(rows), "audits")
    parts = {"s": summary(rows), "f": found, "d": digests(repaired(rows, found))}
    out = convs.select("conv_id").distinct()
    for name, part in parts.items():
        part = part.withColumnRenamed("conv_id", f"_{name}")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS letters
  FROM conversations
), checked AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(letters, lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), CAST([1, 1, 1, 1, 1, 1, 1, 1] AS BIGINT[])),
             lambda v, one: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END))) % 20 AS k
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM checked, LATERAL (SELECT unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END))) AS c(n) WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER w AS place, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN place > min(place) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserts(p, q, cost, audit, said) AS (
  VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
         (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), moves(p, q, initial, name) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
derived(conv_id, place, q, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL
  SELECT conv_id, place, q, cost, audit, said FROM (
    SELECT d.conv_id, r.place, e.q, d.cost + i.cost + e.cost AS cost, d.audit || i.audit || e.audit AS audit, list_concat(list_concat(d.said, i.said), e.said) AS said
    FROM derived d JOIN judged r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.place = d.place + 1 JOIN inserts i ON i.p = d.q,
    LATERAL (
      SELECT i.q AS q, 3 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS said
      UNION ALL
      SELECT m.q, CAST(r.fault = 'truncated' AS INTEGER), 'K', [r.role || ':' || r.text] FROM moves m WHERE m.p = i.q AND m.initial = r.initial AND r.fault IN ('', 'truncated')
      UNION ALL
      SELECT m.q, 2 + CAST(r.fault = 'truncated' AS INTEGER), 'R', [m.name || ':' || r.text] FROM moves m WHERE m.p = i.q AND m.name IS NOT NULL AND r.fault IN ('', 'truncated')
    ) e
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, place, q ORDER BY cost, audit) = 1
), ended AS (
  SELECT d.conv_id, d.cost + i.cost AS cost, d.audit || i.audit AS audit, list_concat(d.said, i.said) AS said
  FROM derived d JOIN (SELECT conv_id, max(place) AS place FROM placed GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.place = d.place
  JOIN inserts i ON i.p = d.q AND i.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost + i.cost, d.audit || i.audit) = 1
), measures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(m.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(m.blank, 0) AS BIGINT) AS blank, CAST(coalesce(m.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(m.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(m.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN measures m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
