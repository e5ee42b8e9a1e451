"""The registered queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .lexscan import ORACLE as LEXSCAN_SQL
from .linefreq import ORACLE as LINE_FREQUENCY_SQL
from .repair import ORACLE as REPAIR_SQL
from .revisits import ORACLE as REVISITS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def public_file(name: str) -> str:
    """Where the public vocabulary files are; a parameter of the operators, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text by the multilingual ranks."""
    import public_tokenizers

    from . import bpe

    return bpe.round_trip_digest(read_table(spark, sf_dir, "documents"), public_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from . import simhash

    found = simhash.components(read_table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", simhash.hex_digits(found.fp).alias("fingerprint"), "component_id")


@query
def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text as token ids in ORC files and describe the documents as read back from them."""
    import uuid

    from . import tokenfiles
    from .common import shared_dir

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write(read_table(spark, sf_dir, "documents"), path, public_file("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.checksums(tokenfiles.read(spark, path))


@query
def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents to 40 shards that each match the mixture of sources."""
    from . import interleave

    return interleave.assign(read_table(spark, sf_dir, "documents"), shards=40)


@query
def op2_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw the corpus anew at 95 % of the greatest source entropy, no source more than four times over."""
    from . import mixture

    docs = read_table(spark, sf_dir, "documents")
    return mixture.realise(docs, mixture.word_count(docs["text"]), budget_ratio=1.0, target_entropy=0.95, max_repetition=4.0)


@query
def op5_langid_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that aren't held out."""
    from . import langid

    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_on_rest(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict for every document."""
    from . import linefreq

    return linefreq.judge(read_table(spark, sf_dir, "documents"))


ORACLES["op3_line_frequency"] = LINE_FREQUENCY_SQL


@query
def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve the not-modified answers among the captures that the pages give."""
    from pyspark.sql import functions as F

    from . import revisits

    found = revisits.resolve(revisits.captures_of(read_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines).withColumnRenamed("headers", "merged_headers")


ORACLES["op7_revisits"] = REVISITS_SQL


#: The key of the surrogates in the registered query; a deployment brings its own.
SURROGATE_KEY = b"registered query"


@query
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    from . import surrogates

    return surrogates.replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query
def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.98 within its label."""
    from . import multiindex

    return multiindex.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98, recall=1.0)


@query
def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    from . import repair

    return repair.report(repair.damage(read_table(spark, sf_dir, "conversations")))


ORACLES["op12_lightest_repair"] = REPAIR_SQL


@query
def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from . import lexscan

    return lexscan.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=50)


ORACLES["op13_automaton_search"] = LEXSCAN_SQL


#: A short list of the kind that a crawl starts from: (host with its subdomains, start of the path, verdict).
URL_LIST = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: by the list, else by the rules mined from the pages that the list covers."""
    from . import urlrules

    pages = read_table(spark, sf_dir, "pages")
    return urlrules.judge(pages, URL_LIST, urlrules.fit(urlrules.listed(pages, URL_LIST)))
