"""Documents to training tokens: five stages, each written as Parquet and read again for the next.

1. language: rejects documents without a letter, and those whose predicted language scores low.
2. lines: removes lines that an earlier line is similar to; documents stay.
3. near_duplicates: keeps one document of each SimHash group.
4. mixing: repeats documents by the target weights of their sources, in random order.
5. tokens: byte-level BPE ids with their digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagepress.llm import bpe, langid, linededup, mixing, simhash
from pagepress.llm.common import shared_checkpoints
from pagepress.llm.queries import VOCABULARY

MIN_SCORE = 0.3  # the mean probability that a language needs at least; a clear text has over 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language. An empty or null text is rejected."""
    predicted = langid.predict(docs, langid.fit(docs))
    kept = predicted.filter((predicted.lang_pred != langid.UNKNOWN) & (predicted.score >= MIN_SCORE))
    return kept.select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return encoded.drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("tokens", tokens),
]

# Neither the network nor the fingerprints can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what stages hand on lies in the shared checkpoint folder."""
    shared_checkpoints(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
