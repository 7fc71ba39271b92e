"""From raw documents to a tokenised training mixture.

Stages, each on all that the one before has kept: documents scored as toxic go;
lines that are similar to an earlier line go; of each group of near copies one
document stays; sources are mixed to target weights; the mixture is encoded.
A text that a stage changes gets its own n_chars.  Null texts stay null up to
the mixing, which takes only documents that have words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, line_dedup, minhash, mixing, toxicity
from docweave.llm.common import documents, materialize, short_batches
from docweave.llm.queries import RANKS


def recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.withColumn("n_chars", F.length("text").cast("bigint")).select(before.columns) if "n_chars" in before.columns else after


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(docs, line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with short_batches(spark):
        return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(docs, mixing.mix_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, memory=100_000)
    with short_batches(spark):
        return materialize(tokens.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")), "pipeline-tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the nearest labelled examples, so the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
