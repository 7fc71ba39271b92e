"""Queries on chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import chunks
from docweave.queries.registry import query, table
from docweave.queries.value_queries import LINES


def drafts(spark, sf_dir):
    """Lines of documents as text drafts under their language and source as headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("headings"), F.posexplode(F.split("text", "\n")).alias("ord", "body"))
    return d.select("doc_id", "ord", F.lit("text").alias("kind"), "headings", "body", F.lit(None).cast("string").alias("caption"), F.array(F.concat(F.lit("#/"), F.col("ord").cast("string"))).alias("refs"))


@query(f"SELECT l.doc_id, l.ln, substr(sha256(d.text), 1, 12) || '-' || lpad((row_number() OVER (PARTITION BY l.doc_id ORDER BY l.ln) - 1)::VARCHAR, 4, '0') AS chunk_id FROM ({LINES}) l JOIN documents d USING (doc_id) WHERE trim(l.line) <> ''")
def chunk_ordinals(spark, sf_dir):
    sha = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    rows = drafts(spark, sf_dir).filter(F.trim("body") != "").select("doc_id", F.col("ord").alias("ln")).join(sha, "doc_id")
    return chunks.chunk_ids(rows, order="ln").select("doc_id", "ln", "chunk_id")


@query()
def chunk_pack(spark, sf_dir):
    """Greedy packing under 128 tokens; order-dependent, so tested by its invariants."""
    packed = chunks.pack(drafts(spark, sf_dir), limit=128)
    return packed.select("doc_id", "part", "kind", F.md5("body").alias("body_md5"), F.length("body").alias("chars"), "token_count", F.size("refs").alias("n_refs"))


@query(
    """WITH l AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '<(h[1-6]|table|img|p)[ >]', 1), lambda x: CASE x WHEN 'table' THEN 'table' WHEN 'img' THEN 'picture' ELSE 'text' END)) AS ks FROM pages)
    SELECT page_id, CASE WHEN len(ks) = 1 THEN ks[1] WHEN len(ks) > 1 THEN 'mixed' ELSE 'text' END AS kind FROM l"""
)
def chunk_kind(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("<(h[1-6]|table|img|p)[ >]"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", chunks.kind(F.transform(tags, lambda x: F.when(x == "img", "picture").otherwise(x))).alias("kind"))


@query(
    r"""WITH c AS (SELECT doc_id, source || ' ' || lang AS caption, CASE WHEN doc_id % 2 = 0 THEN source || '  ' || lang || ' ' || text ELSE text END AS body FROM documents)
    SELECT doc_id, CASE WHEN starts_with(trim(regexp_replace(body, '[\s\p{Z}]+', ' ', 'g')), trim(regexp_replace(caption, '[\s\p{Z}]+', ' ', 'g'))) THEN body ELSE caption || chr(10) || body END AS body FROM c"""
)
def caption_prepend(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    caption = F.concat_ws(" ", "source", "lang")
    begun = F.col("text")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("  "), "lang", F.lit(" "), begun)).otherwise(begun)
    return d.select("doc_id", chunks.with_caption(body, caption).alias("body"))


@query(
    """WITH r AS (SELECT n_regionkey AS doc_id, n_nationkey // 5 AS row, n_nationkey % 5 AS col, n_name AS text FROM nation),
    l AS (SELECT doc_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line, count(*) AS n FROM r GROUP BY doc_id, row)
    SELECT doc_id, string_agg(CASE WHEN row = 0 THEN line || chr(10) || '|' || repeat('---|', n) ELSE line END, chr(10) ORDER BY row) AS body FROM l GROUP BY doc_id"""
)
def table_markdown(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit("#/tables/0").alias("self_ref"), F.expr("n_nationkey div 5").alias("row"), (F.col("n_nationkey") % 5).alias("col"), F.col("n_name").alias("text"))
    return chunks.table_body(n).select("doc_id", "body")


@query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, string_agg(role, ',' ORDER BY t) AS refs FROM f GROUP BY conv_id"""
)
def ordered_refs(spark, sf_dir):
    """Distinct references of a chunk in the order in which they come first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("refs"))
    return c.select("conv_id", F.array_join(F.array_distinct("refs"), ",").alias("refs"))


@query(
    f"""WITH c AS (SELECT doc_id, ln, line, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) AS n FROM ({LINES}) WHERE trim(line) <> '')
    SELECT count(*) AS chunks, max(n)::BIGINT AS max_tokens, sum(n)::BIGINT AS tokens, count_if(n > 64)::BIGINT AS over_64, count(DISTINCT doc_id) AS documents FROM c"""
)
def run_summary(spark, sf_dir):
    from docweave.functions.text import tokens

    rows = drafts(spark, sf_dir).filter(F.trim("body") != "").select("doc_id", F.size(tokens(F.col("body"))).cast("bigint").alias("n"))
    return rows.agg(F.count("*").alias("chunks"), F.max("n").alias("max_tokens"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 64).alias("over_64"), F.count_distinct("doc_id").alias("documents"))


@query("WITH seen AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, sha256(text) AS sha FROM documents ANTI JOIN seen ON sha256(text) = seen.sha")
def cache_antijoin(spark, sf_dir):
    """Documents whose digest is not in the cache yet."""
    from docweave.sources.cache import not_cached

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    cache = d.filter("doc_id % 3 = 0").select("sha")
    return not_cached(d, cache, "sha")


@query("SELECT doc_id, ln, line FROM (" + LINES + ") WHERE contains(lower(line), 'the in')")
def chunk_search(spark, sf_dir):
    from docweave.operators.retrieve import search

    return search(drafts(spark, sf_dir).select("doc_id", F.col("ord").alias("ln"), F.col("body").alias("line")), "the in", ["line"])
