"""The corpus pipeline: documents through five stages, each an operator of ``basewise.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewise.llm import langid, minhash, mixing, packing, substrings
from basewise.llm.common import durable, table
from basewise.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without text or letters go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates on five-word shingles."""
    return minhash.keep_one(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that a document of smaller id has; no document goes."""
    return substrings.without_repeats(docs, min_words=13)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a repeat is a further row."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a token sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_weights),
    ("packing", pack),
]

#: Models, hashes and a tokenizer decide; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
