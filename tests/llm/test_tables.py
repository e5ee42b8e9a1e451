import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import interleave, langid, linefreq, mixture, revisits, surrogates

from .conftest import LONG, ROWS

WORDS = re.compile("[^\x20\x09-\x0d]+")


# Interleaving


def test_interleave(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "b", "c", None]), "t" * rng.randint(0, 9) + "é") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = interleave.assign(df, 40).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(40):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    whole = Counter(r.source for r in got)
    for r in got:
        text = next(x[2] for x in rows if x[0] == r.doc_id)
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "rows", None)
    for source, n in whole.items():  # every shard holds each source in its share, up to rounding
        for shard in range(40):
            here = sum(r.shard == shard and r.source == source for r in got)
            assert abs(here - n * sizes[shard] / 900) < 2
    # Brute force: rank by hash within a source, sort by fractional rank, cut.
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    groups = defaultdict(list)
    for i, s, _ in rows:
        groups["n" if s is None else "s" + s].append(i)
    order = sorted(((rank + 0.5) / len(ids), s, i) for s, ids in groups.items() for rank, i in enumerate(sorted(ids, key=lambda x: h[x])))
    assert {r.doc_id: r.shard for r in got} == {i: pos * 40 // 900 for pos, (_, _, i) in enumerate(order)}


def test_interleave_edges(docs, empty, clean_docs, spark, tmp_path):
    got = interleave.assign(docs, 4).collect()
    assert len(got) == len(ROWS) and {r.shard for r in got} == {0, 1, 2, 3}
    assert interleave.assign(empty, 40).count() == 0
    assert len({r.shard for r in interleave.assign(docs.limit(3), 40).collect()}) == 3
    interleave.write(clean_docs, f"file://{tmp_path}/shards", 4)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == clean_docs.count()


# Mixture


def mixed(spark, sizes, rng, **k):
    rows = [(i, s, rng.randint(1, 9)) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    return rows, mixture.realise(df, F.col("n"), **k).collect(), mixture.source_shares(df, F.col("n"))


def test_temperature_meets_entropy(spark):
    rng = random.Random(2)
    sizes = {"a": 700, "b": 60, "c": 25}
    rows, drawn, shares = mixed(spark, sizes, rng, target_entropy=0.9)
    found = mixture.temperature(shares, 1.0, 0.9)
    assert found.entropy == pytest.approx(0.9 * math.log(3), abs=1e-6)
    total = sum(r[2] for r in rows)
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in sizes}
    powers = {s: (t / total) ** found.exponent for s, t in tokens.items()}
    for s in sizes:
        weight = powers[s] / sum(powers.values())
        mine = [r for r in drawn if r.source == s]
        assert all(r.weight == pytest.approx(weight) for r in mine)
        got = sum(r.n_tokens for r in mine)
        assert weight * total - 1 <= got <= weight * total + 9  # the last document may begin just inside
        full, by_block = int(weight * total // tokens[s]), Counter(r.block for r in mine)
        assert all(by_block[b] == sizes[s] for b in range(full)) and set(by_block) <= set(range(full + 1))
        for block in by_block:  # a block is a permutation, cut at its budget
            part = sorted((r for r in mine if r.block == block), key=lambda r: r.slot)
            assert [r.slot for r in part] == list(range(len(part))) and len({r.doc_id for r in part}) == len(part)
            assert [r.start for r in part] == [sum(x.n_tokens for x in part[:i]) for i in range(len(part))]
    first = [r.doc_id for r in sorted((r for r in drawn if r.source == "c" and r.block == 0), key=lambda r: r.slot)]
    second = [r.doc_id for r in sorted((r for r in drawn if r.source == "c" and r.block == 1), key=lambda r: r.slot)]
    assert set(first) == set(second) and first != second


def test_repetition_limit(spark):
    _, drawn, shares = mixed(spark, {"a": 700, "b": 20, "c": 5}, random.Random(3), target_entropy=0.99, max_repetition=2.0)
    found = mixture.temperature(shares, 1.0, 0.99, 2.0)
    assert 1.99 < found.repetition <= 2.0 and found.entropy < 0.99 * math.log(3)
    assert max(Counter(r.doc_id for r in drawn).values()) <= 2
    plain = mixture.temperature(shares)
    assert plain.exponent == 1.0 and plain.repetition == pytest.approx(1.0)


def test_mixture_edges(docs, empty, clean_docs):
    drawn = mixture.realise(docs, mixture.word_count(F.col("text")), target_entropy=0.5, max_repetition=3.0).collect()
    assert {r.source for r in drawn} == {"s1", "s2", "s3", None}
    assert mixture.realise(empty, mixture.word_count(F.col("text")), target_entropy=0.5).count() == 0
    again = mixture.redraw(docs, mixture.word_count(F.col("text")), 0.9, 4.0)
    assert again.columns == docs.columns and {r.doc_id for r in again.select("doc_id").collect()} == {r[0] for r in ROWS}
    blank = mixture.realise(clean_docs.withColumn("text", F.lit("")), mixture.word_count(F.col("text"))).collect()
    assert len(blank) == clean_docs.count()
    assert clean_docs.select(mixture.word_count(F.col("text")).alias("n")).where("n = 30000").count() == 1


# Line frequency


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures(docs, empty):
    got = [tuple(r) for r in linefreq.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for i, text, *_ in ROWS:
        m = brute_measures(text)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    key = lambda r: (r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert linefreq.judge(empty).count() == 0


def test_repeated_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b"]) if rng.random() < 0.7 else rng.choice("cdefghij") for _ in range(rng.randint(0, 80))), "s") for i in range(60)]
    rows += [(100, "x " * 50 + "# | <>\n\nx\nx\n", "s"), (101, "a b c d e f g h " * 2, "s")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in linefreq.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: brute_measures(t) for i, t, _ in rows}


def test_frequent_lines_go(spark):
    body = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{k}" for k in range(30))
    rows = [(i, f"{body(i)}\nSHARE this  page {i}", "h") for i in range(30)]
    rows += [(100 + i, "share THIS page 9\n" * 9 + "one more", "h") for i in range(3)] + [(200, f"{body(200)}\nShare this page 7", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linefreq.judge(df).collect()}
    assert all(got[i].kept and got[i].n_removed_lines == 1 and got[i].n_removed_words == 4 for i in range(30))
    assert all(not got[100 + i].kept for i in range(3)) and (got[200].kept, got[200].n_removed_lines) == (True, 0)
    cleaned = {r.doc_id: r.text for r in linefreq.clean(df).collect()}
    assert cleaned[0] == body(0) and cleaned[200] == rows[-1][1] and 100 not in cleaned


# Language


def test_language(spark):
    rng = random.Random(5)
    words = {"en": ["the", "house", "with", "water"], "de": ["das", "schön", "zwölf", "über"], "fr": ["été", "garçon", "où", "être"], "ru": ["дом", "вода", "хлеб", "очень"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_on_rest(df)
    got = langid.predict(df, model).withColumn("held_out", langid.held_out("doc_id")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    # Neither order nor neighbours in a batch change a prediction.
    alone = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.repartition(37, "text"), model).collect()}
    assert alone == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_bloom_never_misses(spark):
    text = "some words here and there"
    model = langid.fit(spark.createDataFrame([(text, "en"), (text, "fr")], "text string, lang string"))
    grams = langid._grams([text])[0]
    masks = [int(model.slots[[int(p[0]) for p in langid._positions(grams[k : k + 1])]].min()) for k in range(len(grams))]
    assert masks == [3] * len(grams)


def test_language_edges(docs, empty):
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit_on_rest(docs)).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 11)] == ["und"] * 4 and got[6].lang_pred in ("de", "en", "fr")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, langid.fit(docs)).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {3, 4, 5, 11} & {r.doc_id for r in kept.collect()}


# Revisits

CAPTURES = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark, monkeypatch):
    rng = random.Random(6)
    urls = ["http://Example.com:80/a?b=1&utm_source=x#f", "https://www.example.com/a?b=1", "http://example.com/b", None]
    rows = []
    for i in range(300):
        full = rng.random() < 0.4
        tag = rng.choice(['"1"', '"2"', None])
        rows.append((i, urls[0] if rng.random() < 0.6 else rng.choice(urls), rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randrange(60), "response" if full else "revisit", tag if full or tag is None else rng.choice(["W/", ""]) + tag, rng.choice(["m", "n", None]), rng.choice(["d", None]), {"Date": str(i), "X-Old": "1", "Content-Type": "t"} if full else {"date": str(i), "content-type": "no", "ETag": "e"}))
    key = lambda u: None if u is None else "example.com/b" if u.endswith("/b") else "example.com/a?b=1"
    want = {}
    for i, url, ts, kind, tag, lm, digest, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and key(r[1]) == key(url) and r[2] is not None and ts is not None and r[2] < ts]
        if key(url) is None or ts is None:
            want[i] = ("unplaced", None, None)
        elif not earlier:
            want[i] = ("no_response", None, None)
        else:
            r = max(earlier, key=lambda r: (r[2], r[0]))
            ok = tag.removeprefix("W/") == r[4] if tag and r[4] else lm == r[5] if lm and r[5] else digest is not None and digest == r[6]
            want[i] = ("resolved", r[0], {"content-type": "t", "x-old": "1", "date": headers["date"], "etag": "e"}) if ok else ("mismatch", None, None)
    assert {w[0] for w in want.values()} == {"unplaced", "no_response", "resolved", "mismatch"}
    df = spark.createDataFrame(rows, CAPTURES)
    for slices in (1, 8):
        got = {r.record_id: (r.outcome, r.response_id, {h.key: h.value for h in r.headers} if r.headers else None) for r in revisits.resolve(df, slices).collect()}
        assert got == want


def test_revisit_edges(spark):
    assert revisits.resolve(spark.createDataFrame([], CAPTURES)).count() == 0
    rows = [(1, "http://x/", 1, "response", None, None, None, None), (2, "http://x", 2, "revisit", None, None, None, {"Date": "a", "date": "b"}), (2, "http://x", 2, "revisit", None, None, None, None)]
    assert sorted((r.record_id, r.outcome) for r in revisits.resolve(spark.createDataFrame(rows, CAPTURES)).collect()) == [(2, "mismatch")] * 2


def test_canonical_urls(spark):
    cases = {"HTTP://WWW.Ex.com": "ex.com/", "https://ex.com:443/A?z=1&a=2&UTM_x=3#q": "ex.com/A?a=2&z=1", "ex.com/?ref=1": "ex.com/?ref=1", "http://ex.com?q": "ex.com/?q"}
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert df.where(revisits.canonical_url(F.col("u")) != F.col("want")).count() == 0


# Surrogates

KEY = b"k"


def test_detection():
    text = "A.b@Mail.example.com, +1 (017) 555-7713; 97.51.17.173. 7536784127813050 4845168114407329 token=\"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" Mrs. Anna Smith Госпожа Анна Иванова 123-45-6789 DE89 3704 0044 0532 0130 00 v3.10.2 2024-01-02 12345"
    assert [e[2] for e in surrogates.entities(text)] == ["mail", "phone", "ip", "card", "card", "secret", "name", "name", "ssn", "iban"]
    assert surrogates.entities("x" * 200_000) == [] and surrogates.entities("a" * 100_000 + "@") == []
    assert [e[2:4] for e in surrogates.entities('password=da3cb475b43344af88 PWD: "hunterkey", token = "x"')] == [("secret", "da3cb475b43344af88"), ("secret", "hunterkey")]
    assert [e[3] for e in surrogates.entities("a b@c.de " * 2)] == ["b@c.de"] * 2


def test_replacement(docs, empty, spark):
    got = {r.doc_id: r for r in surrogates.replace(docs, KEY).collect()}
    assert got[7].n_entities == 3 and "mail1" not in got[7].text.lower() and "555-7713" not in got[7].text
    mails = re.findall(r"[\w.]+@[\w.]+", got[7].text)
    assert len(mails) == 2 and mails[0] == mails[1].lower() and mails[1].isupper()
    assert got[3].text is None and got[4].text == "" and got[6].text == LONG and got[1].text == ROWS[0][1]
    assert surrogates.replace(empty, KEY).count() == 0
    assert surrogates.replace(docs, KEY).columns == [c for c in docs.columns if c != "n_entities"] + ["n_entities"]


def test_consistent_by_type():
    draw = lambda kind, x, g="": surrogates.draw(KEY, kind, x, g, 0)
    assert draw("name", "anna smith", "f").split()[0].endswith("a") and draw("name", "анна иванова", "f") == draw("name", "анна иванова", "f")
    assert all("Ѐ" <= c <= "ӿ" for c in draw("name", "анна иванова", "f").replace(" ", ""))
    assert surrogates._luhn(draw("card", "4111111111111111")) == 0 and surrogates._luhn(draw("card", "4111111111111112")) != 0
    assert surrogates.written("phone", draw("phone", "10175557713"), "+1 (017) 555-7713").startswith("+1 (")
    assert surrogates.draw(b"other", "ip", "1.2.3.4", "", 0) != draw("ip", "1.2.3.4")
    assert draw("mail", "x@a.de").split("@")[1] == draw("mail", "y@a.de").split("@")[1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_collisions_are_settled(spark, monkeypatch, broadcast):
    """With few surrogates to draw from, entities still get distinct ones, and none that is an entity."""
    monkeypatch.setattr(surrogates, "draw", few)
    rows = [(i, f"call 123-45-{i:04d} or 123-45-{(i + 1) % 60:04d}") for i in range(60)]
    got = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY, most_broadcast=10**6 if broadcast else 0).collect()
    maps = defaultdict(set)
    for r in got:
        old, new = (re.findall(r"\d{3}-\d\d-\d{4}", x) for x in (rows[r.doc_id][1], r.text))
        for a, b in zip(old, new, strict=True):
            maps[a].add(b)
    assert len(maps) == 60 and all(len(v) == 1 for v in maps.values())
    chosen = [next(iter(v)) for v in maps.values()]
    assert len(set(chosen)) == 60 and not set(chosen) & set(maps)


def few(key, kind, spelling, gender, attempt):
    """A draw with 300 outcomes, entities among them."""
    return f"12345{zlib.crc32(f'{spelling}/{attempt}'.encode()) % 300:04d}"
