"""URL verdicts: the list, rules mined against an exhaustive count, matching against a scan of all rules."""

import itertools
import random
from collections import Counter

import pytest

from quillspark.llm import urlrules
from quillspark.llm.queries import URL_LIST


def urls(n=400, seed=1):
    rng = random.Random(seed)
    hosts = ["a.example.com", "www.b-shop.example.org", "example.org", "cheap.example.net", "blog.x.com"]
    return [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.randrange(300)}{rng.choice(['', '/', '.html', '?utm=1', '#t'])}" for _ in range(n)]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if c.isascii() else c for c in host), rest.split("#")[0].split("?")[0]


def by_list(host, path):
    fits = [(h + p, v) for h, p, v in URL_LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    asked = [*urls(), None, "", "no scheme", "HTTP://EXAMPLE.ORG/es/1", "http://example.org", "http://notexample.org/es/", "x://ÄB.Org?/es/", "://com/fr/", "a://b.com/de/#://x.org/", "http://org/", "http://a.example.org/en/12?x", "http://x.net/" + "seg/" * 50_000, "http://" + "a." * 100_000 + "example.org/es/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(asked)], "page_id long, url string, host string, verdict string").repartition(3)
    mined = urlrules.fit(urlrules.listed(pages, URL_LIST))
    return asked, mined, {r.page_id: r for r in urlrules.judge(pages, URL_LIST, mined).collect()}


def test_list(judged):
    asked, mined, rows = judged
    for i, url in enumerate(asked):
        host, path = parts(url)
        rule, verdict = by_list(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), url
        assert rows[i].verdict == verdict if rule else rows[i].verdict in ("allow", "block")


def test_mined_rules_decide(judged):
    """The inverted index finds what a scan of all rules finds."""
    asked, mined, rows = judged
    assert mined.rules
    for i, url in enumerate(asked):
        if rows[i].rule is None:
            fits = [r for r in mined.rules if set(r.needs) <= set(urlrules.tokens(url))]
            best = min(fits, key=lambda r: r.order, default=None)
            assert (rows[i].verdict, rows[i].because) == ((best.verdict, " ".join(best.needs)) if best else ("allow", None)), url
    assert rows[asked.index("no scheme")].because is None


def test_exhaustive_mining(spark, judged):
    """FP-growth's rules are those of a count of every set of tokens, before pruning by smaller rules and after."""
    labelled = sorted({(u, by_list(*parts(u))[1]) for u in urls() if by_list(*parts(u))[0]})
    df = spark.createDataFrame(labelled, "url string, label string")
    rows = [(r["items"], r.label) for r in urlrules.baskets(df).collect()]
    assert len(rows) == len(labelled)
    sets, hits = Counter(), Counter()
    for items, label in rows:
        assert len(items) <= urlrules.WIDTH
        for k in range(1, urlrules.LONGEST + 1):
            for part in itertools.combinations(sorted(items), k):
                sets[part] += 1
                hits[part, label] += 1
    rules = {(p, label): (n / sets[p], n / len(rows)) for (p, label), n in hits.items() if n >= urlrules.MIN_SUPPORT * len(rows) and n / sets[p] >= urlrules.MIN_CONFIDENCE}
    kept = {
        (p, label): pytest.approx(v)
        for (p, label), v in rules.items()
        if not any(rules.get((q, label), (-1,))[0] >= v[0] for k in range(1, len(p)) for q in itertools.combinations(p, k))
    }
    assert {(r.needs, r.verdict): (r.confidence, r.support) for r in urlrules.fit(df).rules} == kept


def test_no_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    mined = urlrules.fit(urlrules.listed(empty, URL_LIST))
    assert mined.rules == [] and urlrules.judge(empty, URL_LIST, mined).count() == 0
    pages = spark.createDataFrame([(None, "http://x.net/a"), (None, None)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlrules.judge(pages, URL_LIST, mined).collect()] == [(None, "allow")] * 2


def test_repeated_urls_have_one_vote(spark):
    labelled = [("http://h.net/bad/1", "block")] * 50 + [(f"http://h.net/bad/{'abcdefgh'[i]}", "allow") for i in range(8)] + [(None, "block"), ("http://x.net", None)]
    rules = urlrules.fit(spark.createDataFrame(labelled, "url string, label string"))
    assert rules.find(urlrules.tokens("http://h.net/bad/zzz")).verdict == "allow"
