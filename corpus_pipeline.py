"""From raw documents to sharded training text: five stages, each one operator over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, mixing, sharding, simhash
from tidemark.llm.queries import SHARDS, SOURCE_WEIGHTS
from tidemark.llm.text import documents, session, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A document stays if some language makes up half of it or more.
LANGUAGE_SHARE = 0.5
# Jaccard similarity over five-word shingles from which documents are copies of each other.
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of which no language of the labelled ones makes up half."""
    session(spark)
    return language.known_language(docs, language.fit(docs), share=LANGUAGE_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    session(spark)
    return simhash.one_of_each(docs, similarity=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which ten words in a row of a benchmark item occur (or all of a shorter item)."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, never more than twice."""
    session(spark)
    return mixing.mixed(docs, SOURCE_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shards of near equal bytes, with their place in it."""
    session(spark)
    return sharding.sharded(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("shard", shard),
]

# Expectation-maximisation and exact near copies are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result but the last is stored and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
