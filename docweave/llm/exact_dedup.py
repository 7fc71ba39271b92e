"""Exact dedup with a log-structured merge index of text digests.

Every input task is a memtable: it flushes one run, sorted by digest, with a
Parquet bloom filter on the digest column, to the shared folder.  Compaction
merges all runs into one entry per digest.  Digests met more than once are
hits; hits are verified on the bytes of the texts, so that two texts with one
digest could never be taken for one.

Null text counts as the empty text.  A null doc_id takes part like any other
and stays only if the whole group has no other id.  Equal rows count one by
one in ``group_size``; all rows that carry the kept id count as kept.  Only
doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import join_checked, materialize, shared_dir

#: A digest with more than one row in so many is heavy.
HEAVY = 200
#: Digests of groups up to this number are broadcast to fetch their texts.
MAX_BROADCAST = 500_000


class DigestIndex:
    """Sorted runs of (digest, doc_id) in a folder, and their compaction."""

    def __init__(self, spark, path: str | None = None, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep = spark, F.min if keep == "smallest" else F.max
        self.path = path or f"{shared_dir(spark).rstrip('/')}/docweave/lsm-{uuid.uuid4().hex}"
        self.levels = 0

    def flush(self, rows: DataFrame) -> None:
        """Writes one sorted run for each memtable, i.e. task, of (doc_id, digest)."""
        (
            rows.select("digest", "doc_id")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "100000")
            .parquet(f"{self.path}/runs")
        )

    def runs(self) -> DataFrame:
        return self.spark.read.schema("digest binary, doc_id bigint").parquet(f"{self.path}/runs")

    def compact(self) -> DataFrame:
        """Merges all runs: one row (digest, keep_id, n) for each digest."""
        return self.runs().groupBy("digest").agg(self.keep("doc_id").alias("keep_id"), F.count("*").alias("n"))

    def probe(self, digest: Column | bytes) -> DataFrame:
        """Rows of one digest; the runs' filters skip files that lack it."""
        return self.runs().filter(F.col("digest") == digest)


def exact_dedup(docs: DataFrame, keep: str = "smallest", path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession, path, keep)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    digested = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    index.flush(digested)
    entries = materialize(index.compact(), "lsm-level")

    # Fewer than HEAVY digests can have more than one row in HEAVY, so these are broadcast and their rows stay
    # where they are; no task gets all rows of a large group.
    total = entries.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(materialize(entries.filter(F.col("n") * HEAVY > total).filter("n > 1"), "lsm-heavy"))
    hits = entries.filter("n > 1").join(heavy, "digest", "left_anti").select("digest")

    # Grouping hits by their very bytes verifies them; equal texts meet on the map side first.
    met = digested.join(heavy, "digest", "left_semi").unionByName(join_checked(digested.join(heavy, "digest", "left_anti"), hits, "digest", "left_semi", MAX_BROADCAST))
    classes = materialize(met.groupBy("digest", "text").agg(index.keep("doc_id").alias("keep_id"), F.count("*").alias("n")), "lsm-verified")
    mixed = materialize(classes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "lsm-mixed")

    found = index.runs().join(heavy, "digest").unionByName(index.runs().join(heavy, "digest", "left_anti").join(entries, "digest"))
    if not mixed.isEmpty():  # one digest, several texts: these rows are told apart by their bytes
        apart = join_checked(digested, mixed, "digest", "left_semi", MAX_BROADCAST).join(classes, ["digest", "text"])
        found = found.join(mixed, "digest", "left_anti").unionByName(apart.select("digest", "doc_id", "keep_id", "n"))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
