"""Mixing sources to target weights by capped water-filling.

A source's target is its share, by weight, of the words of all sources, but no
more than ``max_epochs`` times its own words; what is cut off goes to the other
sources by weight until no target is above its limit.  A source then gives
whole repetitions of all its documents, and the rest word for word from its
documents in an order drawn by ``seed``: whole documents, and of the last one
only as many words as are still missing.  So a source's taken words equal its
rounded target.

A null text has no words; a null source is a source of its own and comes last.
Equal rows are taken like any others.  Only doc_id, text and source are read for
the plan; the words of a source's documents add up exactly, in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import join_checked

WORD = r"[^\x20\x09-\x0D]+"
#: A per-source table up to this many rows is broadcast.
MAX_BROADCAST_SOURCES = 10_000
#: Hex digits of the draw that split a source; so no source is one task's work.
SPLIT = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fill(sources: DataFrame, cycle: int = 3, max_epochs: int = 3) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source.

    Sources by code point, null last, weigh 1, 2, .. ``cycle``, repeating.
    Taken in the order in which they reach their limit as the level rises, the
    sources before the first one that stays below it are at their limit.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("limit", F.col("source_size") * max_epochs)
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("below", F.col("rest") * F.col("weight") <= F.col("limit") * F.col("open"))
    )
    # Past the first source below its limit the level only falls, so that source has the largest.
    first = F.max(F.when(F.col("below"), F.col("level"))).over(everything)
    return levels.withColumn("level_found", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("below"), F.col("level_found") * F.col("weight")).otherwise(F.col("limit").cast("double")).alias("target"),
    )


def draw(seed: str) -> Column:
    """A document's place in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, seed: str = "mix-1", cycle: int = 3, max_epochs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """The plan: doc_id, size, source_size, target, taken, and the columns in ``keep``.

    ``taken`` counts words, those of repetitions too, so ``taken`` div ``size``
    is the number of whole repetitions and the remainder the words of the last.
    """
    kept = [F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(seed).alias("draw"), *kept).withColumn("part", F.substring("draw", 1, SPLIT))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = fill(parts.groupBy("source").agg(F.sum("part_size").cast("bigint").alias("source_size")), cycle, max_epochs)
    sources = sources.select(F.col("source").alias("of"), "source_size", "target").withColumn("wanted", F.round("target").cast("bigint"))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0))).withColumn("rest", F.col("wanted") - F.col("whole") * F.col("source_size"))
    in_order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before_part", F.coalesce(F.sum("part_size").over(in_order), F.lit(0)))
    parts = join_checked(parts, sources, F.col("source").eqNullSafe(F.col("of")), "inner", MAX_BROADCAST_SOURCES).drop("of", "part_size")
    parts = parts.withColumnsRenamed({"source": "of", "part": "of_part"})
    in_part = W.partitionBy("source", "part").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before_part") - F.col("before")))
    joined = rows.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its first ``n`` words, its white space included."""
    spans = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(spans, F.lit(1), n.cast("int")), "")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``.

    Whole repetitions are rows of their own; the one document of a source that
    is taken in part has its first words only.  Documents without words carry
    nothing to the mixture and are not in it.
    """
    plan = mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), keep=("row",), **options)  # has the text once
    whole, part = F.expr("taken div size"), F.expr("taken % size")
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("bigint"), whole.cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    rows = plan.filter("taken > 0").withColumn("part", F.explode(copies))
    text = F.when(F.col("part") > 0, first_words(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open FROM w
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN rest * weight <= cap * open
    THEN max(CASE WHEN rest * weight <= cap * open THEN rest::DOUBLE / open::DOUBLE END) OVER () * weight ELSE cap::DOUBLE END AS target FROM l),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM r
"""
