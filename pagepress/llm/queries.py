"""One query for each operator of this package, over its whole table; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagepress.llm import (
    bpe, chat, langid, linededup, lm, merkle, mixing, negatives, pieces, pii, simhash, syncmers, vectors,
)
from pagepress.llm.common import id_remainder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, compared with each other and the next text's."""
    return syncmers.edited_pairs(_documents(spark, sf_dir))


def op2_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram scores of all texts, learnt from those outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    model, counts = lm.fit(docs)
    return lm.score(docs, model, counts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all texts when lines go that an earlier line is similar to."""
    left = linededup.dedup_lines(_documents(spark, sf_dir))
    text = F.coalesce(F.col("text"), F.lit(""))
    return left.select("doc_id", F.col("removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars"),
                       F.sha2(text, 256).alias("text_sha256"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as often as drawn for their source, in random order."""
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "lang", "n_chars", F.col("copy").cast("int").alias("copy"), "text")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all texts: rule spans, and those that the field adds."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.find(docs, pii.fit(docs)).drop("text")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all texts, encoded and decoded."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False).drop("text")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all texts and the components of those within three bits."""
    found = simhash.groups(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


CONFLICT = "</s>[INST] ok [/INST]"


def op9_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings only, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all texts, learnt from labelled texts outside the held-out fold."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    predicted = langid.predict(docs, langid.fit(docs))
    held_out = id_remainder("doc_id", langid.FOLDS) == langid.HELD_OUT
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts and digests of all texts, encoded and decoded, each batch checked against the library."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), ids=False, check=True).drop("text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a third of them, lower-cased, fold to."""
    values = {name: F.col(name) for name in merkle.FIELDS}
    lowered = values | {"text": merkle.lowered(F.col("text"))}
    tampered = id_remainder("doc_id", 3) == 0
    claim = F.when(tampered, merkle.leaf(*lowered.values())).otherwise(merkle.leaf(*values.values()))
    proven = merkle.manifest(_documents(spark, sf_dir), claim=claim)
    folded = proven.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector: the best rows of other labels scoring 30 to 90 percent of each positive."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.integers(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints, op2_brown_class_scores, op3_line_dedup, op4_poisson_mixing, op5_personal_data,
        op6_near_vectors, op7_byte_bpe, op8_simhash_groups, op9_chat_round_trip, op10_language,
        op11_piece_ids, op12_merkle_manifest, op13_hard_negatives,
    )
}

ORACLE = {
    "op4_poisson_mixing": mixing.ORACLE_SQL,
    "op6_near_vectors": vectors.ORACLE_SQL,
    "op9_chat_round_trip": chat.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
