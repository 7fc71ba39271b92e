"""Queries on layout clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import furniture_key
from docweave.operators import layout
from docweave.operators.joins import broadcast_if_small
from docweave.queries.registry import query, table
from docweave.queries.value_queries import LINES, furniture_sql, lines, strip_sql

KEYS = f"SELECT doc_id, ln, line, {furniture_sql('line')} AS key FROM ({LINES})"
REPEATED = f"SELECT key, count(DISTINCT doc_id) AS pages FROM ({KEYS}) WHERE length(key) >= 4 GROUP BY key HAVING count(DISTINCT doc_id) >= 3"


def repeated(spark, sf_dir):
    """Lines that occur in three documents or more; documents stand for pages."""
    rows = lines(spark, sf_dir).withColumnRenamed("line", "text")
    return layout.repeated_keys(rows, page="doc_id", keys=())


@query(REPEATED)
def furniture_key_counts(spark, sf_dir):
    return repeated(spark, sf_dir)


@query(f"SELECT k.doc_id, k.ln, k.key FROM ({KEYS}) k SEMI JOIN ({REPEATED}) r ON k.key = r.key")
def repeated_furniture(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "ln", furniture_key(F.col("line")).alias("key"))
    return rows.join(broadcast_if_small(repeated(spark, sf_dir).select("key")), "key", "left_semi")


@query(
    f"SELECT k.doc_id, count_if(r.key IS NULL)::BIGINT AS kept_lines, count_if(r.key IS NOT NULL)::BIGINT AS moved_lines, sum(CASE WHEN r.key IS NULL THEN length(k.line) ELSE 0 END)::BIGINT AS kept_chars "
    f"FROM ({KEYS}) k LEFT JOIN ({REPEATED}) r ON k.key = r.key GROUP BY k.doc_id"
)
def furniture_stripped_docs(spark, sf_dir):
    """The flagship: documents without repeated furniture."""
    rows = lines(spark, sf_dir).select("doc_id", F.length("line").alias("len"), furniture_key(F.col("line")).alias("key"))
    joined = rows.join(broadcast_if_small(repeated(spark, sf_dir).select("key", F.lit(True).alias("moved"))), "key", "left")
    return joined.groupBy("doc_id").agg(
        F.count_if(F.col("moved").isNull()).alias("kept_lines"),
        F.count_if(F.col("moved").isNotNull()).alias("moved_lines"),
        F.sum(F.when(F.col("moved").isNull(), F.col("len")).otherwise(0)).alias("kept_chars"),
    )


PREFIXES = ("The ", "Und", "In ", "###")


@query(f"SELECT doc_id, count_if({' OR '.join(f'''starts_with({strip_sql('line')}, '{p}')''' for p in PREFIXES)})::BIGINT AS furniture, count(*) AS items FROM ({LINES}) GROUP BY doc_id")
def prefix_furniture(spark, sf_dir):
    items = lines(spark, sf_dir).select("doc_id", F.col("line").alias("text"), F.lit("BODY").alias("layer"))
    moved = layout.prefix_furniture(items, PREFIXES)
    return moved.groupBy("doc_id").agg(F.count_if(F.col("layer") == "FURNITURE").alias("furniture"), F.count("*").alias("items"))


BOXES = "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS l, l_quantity + 100 AS t, l_quantity + l_tax * 1000 AS r, l_quantity + 20 AS b, CASE WHEN l_linenumber = 7 THEN NULL ELSE 800.0 END AS h FROM lineitem"


@query(f"SELECT id, line, round(h - t, 6) AS top, round(h - b, 6) AS bottom, round(coalesce(abs(r - l) * abs(t - b) / (600 * h), 1.0), 6) AS area FROM ({BOXES})")
def boxes(spark, sf_dir):
    """Boxes seen from the top left, and the share of the page that they take."""
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.struct(F.col("l_quantity").alias("l"), (F.col("l_quantity") + 100).alias("t"), (F.col("l_quantity") + F.col("l_tax") * 1000).alias("r"), (F.col("l_quantity") + 20).alias("b")).alias("bbox"),
        F.when(F.col("l_linenumber") != 7, F.lit(800.0)).alias("h"),
    )
    flipped = layout.top_left(F.col("bbox"), F.col("h"))
    area = layout.area_fraction(F.col("bbox"), F.lit(600.0), F.col("h"))
    return x.select("id", "line", F.round(flipped["t"], 6).alias("top"), F.round(flipped["b"], 6).alias("bottom"), F.round(area, 6).alias("area"))


@query(
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>', 1)) AS level FROM pages)
    SELECT page_id, level::INT AS level, count(*) AS n FROM h GROUP BY ALL"""
)
def html_heading_levels(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), F.lit(1))).alias("level"))
    return p.groupBy("page_id", F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


#: Conversations as headings: some turns carry a section number.
HEADING_TEXT = "CASE turn % 4 WHEN 1 THEN turn || '.' || (conv_id % 3) || '.2 ' || role WHEN 3 THEN turn || '. ' || role ELSE role || ' ' || turn END"


@query(
    rf"""WITH h AS (SELECT conv_id AS doc_id, turn AS pos, {HEADING_TEXT} AS text, 2 AS level FROM conversations),
    n AS (SELECT *, regexp_extract(text, '^\s*(\d+(\.\d+)*)\.?\s+\S', 1) AS num FROM h),
    l AS (SELECT *, CASE WHEN num <> '' THEN length(num) - length(replace(num, '.', '')) + 1 END AS own FROM n),
    p AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM l)
    SELECT doc_id, pos, coalesce(own, CASE WHEN parent IS NOT NULL THEN least(parent + 1, 6) END, level)::INT AS new_level FROM p"""
)
def heading_repair(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.expr(HEADING_TEXT).alias("text"), F.lit(2).alias("level"))
    return layout.heading_levels(c).select("doc_id", "pos", F.col("new_level").cast("int").alias("new_level"))


def crumb_sql() -> str:
    w = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"max(CASE WHEN lv = {k} THEN turn END) {w} AS p{k}, last_value(CASE WHEN lv = {k} THEN t END IGNORE NULLS) {w} AS t{k}" for k in range(1, 7))
    parts = ", ".join("CASE WHEN " + " AND ".join([f"p{k} IS NOT NULL", *(f"(p{a} IS NULL OR p{a} < p{k})" for a in range(1, k))]) + f" THEN t{k} END" for k in range(1, 7))
    return f"WITH h AS (SELECT conv_id, turn, 1 + (turn * 7 + conv_id) % 3 AS lv, role || turn AS t FROM conversations), w AS (SELECT conv_id, turn, {cols} FROM h) SELECT conv_id, turn, concat_ws(' > ', {parts}) AS crumb FROM w"


@query(crumb_sql())
def breadcrumb(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.lit("section_header").alias("label"),
        (1 + (F.col("turn") * 7 + F.col("conv_id")) % 3).alias("level"), F.concat(F.col("role"), F.col("turn").cast("string")).alias("text"),
    )
    return layout.breadcrumbs(c).select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), F.array_join("breadcrumb", " > ").alias("crumb"))


CAPTION_TEXT = "CASE WHEN (conv_id + turn) % 4 = 0 THEN 'Tabelle ' || turn || ': ' || role ELSE text END"


@query(
    rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace({CAPTION_TEXT}, '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM conversations),
    n AS (SELECT conv_id, turn, lead(t, 1) OVER w AS a, lag(t, 1) OVER w AS b, lead(t, 2) OVER w AS c FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, coalesce({', '.join(rf"CASE WHEN regexp_matches({x}, '^(?i:tabelle|tab\.|table)\s*\d+') AND length({x}) < 200 THEN {x} END" for x in 'abc')}) AS caption FROM n"""
)
def caption_neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(CAPTION_TEXT).alias("text"), F.lit("text").alias("label"))
    return c.select("conv_id", "turn", layout.nearby_caption(layout.TABLE_CAPTION, partition="conv_id", order="turn").alias("caption"))


#: Order lines as tables: the line status stands for the header row, some have captions of their own.
TABLES = """SELECT doc_id, pos, CASE WHEN pos = 5 THEN '' ELSE l_linestatus END AS header, CASE WHEN l_partkey % 5 = 0 THEN concat('own ', pos) END AS explicit,
  CASE WHEN l_suppkey % 3 = 0 THEN concat('near ', pos) END AS nearby FROM (
    SELECT *, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus) AS pos FROM lineitem)"""


@query(
    f"""WITH RECURSIVE t AS (SELECT *, pos AS i FROM ({TABLES})),
    r(doc_id, pos, i, header, caption, inferred) AS (
      SELECT doc_id, pos, i, header, coalesce(explicit, nearby), explicit IS NULL AND nearby IS NOT NULL FROM t WHERE i = 1
      UNION ALL
      SELECT t.doc_id, t.pos, t.i, t.header, coalesce(t.explicit, CASE WHEN t.header = r.header AND t.header <> '' THEN r.caption END, t.nearby),
        t.explicit IS NULL AND coalesce(CASE WHEN t.header = r.header AND t.header <> '' THEN r.caption END, t.nearby) IS NOT NULL
      FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + 1)
    SELECT doc_id, pos, caption, inferred FROM r"""
)
def caption_continuation(spark, sf_dir):
    spark_sql = TABLES.replace("FROM lineitem", "FROM {lineitem}")
    line = spark.sql(spark_sql, lineitem=table(spark, sf_dir, "lineitem"))
    return layout.continued_captions(line).select("doc_id", "pos", "caption", "inferred")


@query()
def dehyphenated_cells(spark, sf_dir):
    """Cells made of line ends and beginnings; look-around has no SQL counterpart in the oracle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r" (\p{L})", "- $1").alias("text"))
    return layout.dehyphenate_cells(d).select("doc_id", "text", "changed")
