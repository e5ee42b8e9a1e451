"""The corpus pipeline: language, near-duplicates, personal data, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each result as Parquet in
the session's shared folder and reads it back, so no stage is computed twice and lost executors cost one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, langid, mixture, nearcopies, surrogates
from quillspark.llm.common import discard, materialize, read_table, scratch, shared_dir, small_batches

#: The key of the surrogates; a deployment brings its own.
KEY = b"corpus pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, their lang set to it."""
    small_batches(spark)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles at Jaccard similarity 0.8 or more."""
    small_batches(spark)
    return nearcopies.keep_one(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    small_batches(spark)
    return surrogates.replace(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources asks, each at least once."""
    return mixture.redraw(docs, mixture.word_count(docs["text"]), target_entropy=0.95, max_repetition=4.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every draw."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_ids(docs.select("doc_id", "source", "lang", "text"), path, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII surrogates", personal_data),
    ("mixing sources", mix),
    ("byte-level BPE", token_ids),
]

#: Fingerprints, keyed surrogates and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to documents. A stage's own tables go with it, and its result once the next one is written."""
    docs, written = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = shared_dir(spark)
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), "pipeline", folder)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
