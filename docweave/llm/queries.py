"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, fingerprints, line_dedup, lm_scoring, minhash, mixing, secrets, substring_dedup, toxicity
from docweave.llm.common import documents
from docweave.llm.exact_dedup import exact_dedup

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(documents(spark, sf_dir), labels)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("nearest_ids"),
        "evidence",
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text."""
    out = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edited(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sample")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sample"), F.col("edited")).alias("near_edited"),
        fingerprints.likeness(F.col("sample"), F.col("next_sample")).alias("near_next"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_components(documents(spark, sf_dir), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL = {
    "op4_mixing": mixing.MIX_SQL,
    "op6_exact_dedup": OP6_SQL,
}
