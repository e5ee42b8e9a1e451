"""URL filtering by association rules over URL tokens, mined from labelled URLs with Spark's FP-growth.

A URL is a set of tokens: scheme, host labels and top-level domain, each path segment with its depth and each of its words, the
suffix of the last segment, names of query fields; runs of digits are one token whatever their value. A basket is a labelled URL's set and
its label. FP-growth mines the sets that at least ``MIN_SUPPORT`` of the baskets hold; rules "tokens -> label" of confidence ``MIN_CONFIDENCE``
and more stay if no rule with fewer of their tokens and the same label is as sure (``Rules.pruned``).

Each rule is posted under its rarest token in an inverted index. A URL looks up its own tokens, and of the rules posted there that it
holds wholly the surest decides (then the longer one, the better supported one, the first in order); without any, ``default``.

Bounds: about ``FIT_ROWS`` distinct labelled URLs at most, chosen by a hash, are fitted on (a documented sample; all URLs are judged, and a URL
that is repeated often has one vote). A basket keeps its ``WIDTH`` tokens that tell most about the label. So at most sum(C(WIDTH, k), k <= LONGEST) / MIN_SUPPORT = 77,000 rules exist, however
many URLs there are; that is what reaches the driver and is broadcast. The list of fixed rules is the caller's, a Python list.

Hosts fit a list's rule by equality or as its subdomain, paths by their start; the longest rule (host and path together) wins, then the longer
host, then allow before block. A null URL, or one without ``://``, has empty host and path, no tokens and the default verdict. Repeated rows are
judged alike. Without labelled URLs (or an empty table) there are no mined rules. Null labels aren't learned from. Only the
named columns are read, so others can't clash.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIT_ROWS = 200_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: Tokens of a basket, and of a rule.
WIDTH, LONGEST = 10, 4
ALLOW, BLOCK = "allow", "block"
LABEL = "label="

#: (host, start of the path, verdict)
Listed = tuple[str, str, str]


def lower(text: Column) -> Column:
    """text with A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str | None) -> list[str]:
    """The sorted tokens of a URL."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return []
    cut = re.search("[/?#]", rest)
    name, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    way, _, query = rest.partition("#")[0].partition("?")
    found = {f"scheme={scheme.lower()}"}
    labels = [x for x in re.sub("[0-9]+", "0", name.lower().partition(":")[0]).split(".") if x]
    found |= {f"host={x}" for x in labels[:-1]} | {f"top={x}" for x in labels[-1:]}
    found |= {f"word={w}" for x in labels[:-1] for w in x.split("-") if w and w != x}
    segments = [x for x in re.sub("[0-9]+", "0", way.lower()).split("/") if x]
    for depth, segment in enumerate(segments):
        found |= {f"path{depth}={segment}"} | {f"word={w}" for w in re.split("[-_.+]", segment) if w not in ("", "0", segment)}
    if segments and "." in segments[-1]:
        found.add("suffix=" + segments[-1].rpartition(".")[2])
    found |= {"field=" + x.partition("=")[0].lower() for x in query.split("&") if x}
    return sorted(found)


class HostList:
    """The list of fixed rules: longest match by the ends of a host and the start of a path."""

    def __init__(self, rules: list[Listed]):
        self.of: dict[str, list[tuple[str, str]]] = {}
        for name, start, verdict in rules:
            self.of.setdefault(name.lower(), []).append((start, verdict))
        self.most = max((name.count(".") + 1 for name in self.of), default=0)  # labels of a rule's host; longer ends of a host can't fit

    def find(self, name: str, way: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        labels = name.split(".")
        fits = [
            (len(end) + len(start), len(end), verdict == ALLOW, end + start, verdict)
            for i in range(max(0, len(labels) - self.most), len(labels))
            for end in [".".join(labels[i:])]
            for start, verdict in self.of.get(end, ())
            if way.startswith(start)
        ]
        return max(fits)[3:] if fits else None


@dataclasses.dataclass(frozen=True)
class Rule:
    needs: tuple[str, ...]
    verdict: str
    confidence: float
    support: float

    @property
    def order(self) -> tuple:
        """The surest rule is the least."""
        return -self.confidence, -len(self.needs), -self.support, self.needs, self.verdict


class Rules:
    """Mined rules, each posted under its rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.rules = sorted(rules, key=lambda r: r.order)
        self.posted: dict[str, list[Rule]] = {}
        for rule in self.rules:
            self.posted.setdefault(min(rule.needs, key=lambda t: (frequency.get(t, 0), t)), []).append(rule)

    @staticmethod
    def pruned(rules: list[Rule]) -> list[Rule]:
        """rules without those that say no more than one with fewer tokens."""
        sure: dict[tuple, float] = {}
        kept = []
        for rule in sorted(rules, key=lambda r: len(r.needs)):
            smaller = (part for k in range(1, len(rule.needs)) for part in itertools.combinations(rule.needs, k))
            if all(sure.get((part, rule.verdict), -1.0) < rule.confidence for part in smaller):
                kept.append(rule)
            sure[rule.needs, rule.verdict] = rule.confidence
        return kept

    def find(self, held: list[str]) -> Rule | None:
        """The surest rule whose tokens are all held."""
        own = set(held)
        fits = (next((r for r in self.posted.get(t, ()) if own.issuperset(r.needs)), None) for t in own)
        return min((r for r in fits if r), key=lambda r: r.order, default=None)


def listed(pages: DataFrame, rules: list[Listed]) -> DataFrame:
    """(url, label): the pages that the list covers, labelled by it."""
    table = HostList(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [table.find(h.as_py(), p.as_py()) for h, p in zip(batch.column("host"), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array([f and f[1] for f in found], pa.string())], ["url", "label"])

    return pages.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).mapInArrow(run, "url string, label string").where("label is not null")


def baskets(labelled: DataFrame) -> DataFrame:
    """Written (items, label, row): of about FIT_ROWS distinct labelled URLs at most, the tokens that are frequent and tell most about the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tokens(x.as_py()) for x in batch.column("url")]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string())), batch.column("label")], ["items", "label"])

    known = labelled.where("url is not null and label is not null").select("url", "label")
    every = max(1, -(-known.distinct().count() // FIT_ROWS))
    few = known.where(F.pmod(F.xxhash64("url"), F.lit(every)) == 0).distinct()
    rows = materialize(few.mapInArrow(run, "items array<string>, label string").withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    total = rows.count()
    each = rows.select("row", F.col("label") == BLOCK, F.explode("items").alias("token")).toDF("row", "bad", "token")
    share = rows.agg(F.coalesce(F.avg((F.col("label") == BLOCK).cast("double")), F.lit(0.0))).first()[0]
    stats = each.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k")).where(F.col("n") >= MIN_SUPPORT * total)
    # How far a token's labels are from the whole's, in standard errors squared.
    tells = F.pow(F.col("k") - F.col("n") * share, 2) / (F.col("n") * max(share * (1 - share), 1e-9))
    best = Window.partitionBy("row").orderBy(F.desc("tells"), "token")
    kept = each.join(stats.select("t", tells.alias("tells")), F.col("token") == F.col("t")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= WIDTH)
    chosen = kept.groupBy("row").agg(F.sort_array(F.collect_list("token")).alias("chosen"))
    return materialize(rows.select("row", "label").join(chosen, "row", "left").select(F.coalesce("chosen", F.array().cast("array<string>")).alias("items"), "label", "row"), "baskets")


def fit(labelled: DataFrame) -> Rules:
    """The rules mined from labelled (url, label) with labels allow and block."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets(labelled)
    total = rows.count()
    if not total:
        return Rules([], {})
    frequency = {r.t: r.n for r in rows.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # frequent tokens, at most WIDTH / MIN_SUPPORT
    with_label = rows.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(with_label)
    found = model.associationRules.where(F.col("consequent")[0].isin(LABEL + ALLOW, LABEL + BLOCK) & (F.size("antecedent") <= LONGEST)).collect()  # within the bound above
    rules = [Rule(tuple(sorted(r.antecedent)), r.consequent[0].removeprefix(LABEL), round(r.confidence, 12), round(r.support, 12)) for r in found]
    return Rules(Rules.pruned(rules), frequency)


def judge(pages: DataFrame, rules: list[Listed], mined: Rules, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict, because, confidence) of every row of pages: rule names the list's, because the mined rule's tokens."""
    table = HostList(rules)
    shared = pages.sparkSession.sparkContext.broadcast(mined)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for name, way, url in zip(*[batch.column(c).to_pylist() for c in ("host", "path", "url")], strict=True):
                if fixed := table.find(name, way):
                    out.append((*fixed, None, None))
                elif found := model.find(tokens(url)):
                    out.append((None, found.verdict, " ".join(found.needs), found.confidence))
                else:
                    out.append((None, default, None, None))
            columns = zip(*out, strict=True) if out else [()] * 4
            made = [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path")], *made], ["page_id", "host", "path", "rule", "verdict", "because", "confidence"])

    asked = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "url")
    return asked.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, because string, confidence double")
