import random
import zlib

import pytest

from quillspark.llm import langid

WORDS = {"en": ["the", "house", "with", "water", "under", "bridge"], "de": ["das", "schön", "zwölf", "über", "straße", "garten"], "fr": ["été", "garçon", "où", "être", "maison", "rivière"], "es": ["niño", "agua", "puente", "mañana", "ciudad", "donde"]}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_only_texts_of_a_learned_language_stay(spark, n):
    rng = random.Random(8)
    use = list(WORDS)[:n]
    rows = [(i, " ".join(rng.choice(WORDS[use[i % n]]) for _ in range(rng.randint(8, 60))), use[i % n]) for i in range(60 * n)]
    for i in range(12):  # not held out or held out, labelled as the tables label junk
        noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(40))
        rows += [(1000 + i, noise, "en"), (2000 + i, "однажды весною в час заката на прудах появились два гражданина " * 3 + "the house", "en")]
    # What nothing is learned from is judged as well as what is.
    kept = {r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id < 1000").collect()}
    assert kept == set(range(60 * n))
    model = langid.fit(spark.createDataFrame(rows[: 60 * n], "doc_id long, text string, lang string"))
    covered = langid.scores(model, [r[1] for r in rows])[2]
    assert covered[: 60 * n].min() >= 0.3 > covered[60 * n :].max()


def test_misfits_go(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(30)), "en") for i in range(80)]
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 4 == 2][:40]
    rows += [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)) if k % 2 else "однажды весною в час заката на прудах появились граждане the house", "en") for k, i in enumerate(held)]
    kept = {r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(80))
