import pytest

LONG = "wort " * 30_000
#: (doc_id, text, lang, source, n_chars): nulls, blanks, ties, repeats, scripts and one long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old barn", "en", "s1", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old barn", "en", "s1", 1),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, "   \t\n ", None, "s1", 6),
    (6, LONG, "de", "s1", len(LONG)),
    (7, "Mail a.b@mail1.example.com or A.B@MAIL1.EXAMPLE.COM, phone +1 (017) 555-7713.", "en", None, 3),
    (8, "naïve café 日本語 🙂 ß ﷺ  two  spaces\r\ntabs\tend \n\n\nlast", "fr", "s2", 4),
    (9, "line one\nline one\nline two 1\nline two 2", "en", "s1", 5),
    (9, "line one\nline one\nline two 1\nline two 2", "en", "s1", 5),
    (None, "orphan without an id", "en", "s1", 6),
    (10, "one", "en", "s3", 3),
    (11, "!!! ??? ... 123", None, "s3", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["count", "block", "slot", "fp", "score", "lang_pred", "ids", "tokens", "n_entities", "shard", "_rank", "id", "kept", "start"]
    return df.withColumns({c: F.lit(-1) for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clean_docs(spark):
    """The rows that have an id, each once."""
    return spark.createDataFrame([r for i, r in enumerate(ROWS) if r[0] is not None and r[0] not in {x[0] for x in ROWS[:i]}], SCHEMA)
