"""From documents to clean items, chunks with vectors, and graph nodes, in one lazy plan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import pyspark
from docweave.operators import chunks as chunk_ops
from docweave.operators import graph, layout
from docweave.plans import providers
from docweave.plans.settings import Settings

VERSION = "0.1"


def cache_key(sha: str, settings: Settings, schema_hash: str) -> str:
    """Of all that a result depends on: the document, every setting that is not a secret, the schema, the version."""
    plain = {s: {k: v for k, v in values.items() if k not in ("api_key", "cache_dir")} for s, values in asdict(settings).items()}
    return hashlib.sha256(json.dumps([sha, plain, schema_hash, VERSION], sort_keys=True).encode()).hexdigest()


def clean(items: DataFrame, settings: Settings) -> DataFrame:
    """Furniture first, then heading levels; the order is part of the result."""
    out = layout.prefix_furniture(items, settings.chunking.furniture_prefixes) if settings.chunking.furniture_prefixes else items
    if "bbox" in items.columns:
        out = layout.repeated_furniture(out, settings.chunking.furniture_min_pages, settings.chunking.furniture_band)
    if settings.parsing.heading_levels:
        is_heading = (F.col("label") == "section_header") & (F.col("layer") == layout.BODY)
        levels = layout.heading_levels(out.filter(is_heading).select("doc_id", "pos", "text", "level")).select("doc_id", "pos", "new_level")
        out = out.join(levels, ["doc_id", "pos"], "left").withColumn("level", F.coalesce("new_level", "level")).drop("new_level")
    return out


def drafts(items: DataFrame) -> DataFrame:
    """Body items that are not headings, under their open headings."""
    body = layout.breadcrumbs(items.filter(F.col("layer") == layout.BODY))
    rows = body.filter((F.col("label") != "section_header") & (F.trim("text") != ""))
    kind = F.when(F.col("label").isin("table", "picture"), F.col("label")).otherwise("text")
    return rows.select("doc_id", F.col("pos").alias("ord"), kind.alias("kind"), F.col("breadcrumb").alias("headings"), F.col("text").alias("body"), F.lit(None).cast("string").alias("caption"), F.array("self_ref").alias("refs"))


def process(items: DataFrame, settings: Settings | None = None, embedder: Callable[[], providers.Embedder] | None = None, patterns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """items, markdown, chunks (with vectors, if an embedder is given), chunk_ref, and nodes by ``patterns``.

    doc_id is the document's digest.  Stages that are turned off are left out.
    """
    settings = settings or Settings()
    cleaned = clean(items, settings)
    out = {"items": cleaned, "markdown": layout.markdown(cleaned)}
    packed = chunk_ops.pack(drafts(cleaned), settings.chunking.max_tokens, settings.chunking.merge_peers)
    chunked = chunk_ops.chunk_ids(packed, sha="doc_id").withColumn("text", F.when(F.size("headings") > 0, F.concat(F.array_join("headings", "\n"), F.lit("\n"), F.col("body"))).otherwise(F.col("body")))
    if settings.embedding.enabled and embedder:
        chunked = chunked.withColumn("embedding", providers.embed(F.col("text"), embedder, settings.embedding.batch, settings.embedding.prefix))
    out["chunks"] = chunked
    out["chunk_ref"] = chunk_ops.chunk_refs(chunked)
    if settings.extraction.enabled and patterns:
        found = providers.extract_by_rules(chunked, patterns)
        keyed_nodes = found.withColumn("node_id", graph.node_id(F.col("class"), F.col("label")))
        out["nodes"] = keyed_nodes.groupBy("class", "node_id").agg(F.min("label").alias("label"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return out


def summary(chunks: DataFrame) -> DataFrame:
    embedded = F.count("embedding") if "embedding" in chunks.columns else F.lit(0).cast("bigint")
    return chunks.groupBy("kind").agg(F.count("*").alias("chunks"), F.max("token_count").alias("max_tokens"), embedded.alias("embedded"))


def self_check(spark: SparkSession, settings: Settings | None = None) -> dict:
    """Each check with its outcome; any that fails makes the whole degraded."""
    checks: dict[str, str] = {}
    for name, check in {
        "spark": lambda: spark.range(3).count() == 3,
        "tokenizer": lambda: chunk_ops.count_tokens("two words") == 2,
        "ontology": lambda: settings is None or settings.service.ontology is None or bool(open(settings.service.ontology).close() or True),
    }.items():
        try:
            checks[name] = "ok" if check() else "failed"
        except Exception as e:  # noqa: BLE001 - the check's outcome is the message
            checks[name] = str(e)[:200]
    return {"status": "ok" if all(v == "ok" for v in checks.values()) else "degraded", "checks": checks}


def capabilities() -> dict:
    from docweave.sources.documents import ENDINGS, PARSED

    return {"version": VERSION, "spark": pyspark.__version__, "formats": sorted(set(ENDINGS.values())), "parsed_here": list(PARSED), "chunk_tokens": [64, 8192], "contracts": ["dense", "direct"]}


def order_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")
