"""Layout clean-up on items(doc_id, pos, self_ref, label, layer, level, text, page_no, bbox, page_w, page_h).

Order matters: furniture goes first, since items that leave the body take no
part in headings, captions or chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.text import dehyphenate, furniture_key, squeeze, strip

BODY, FURNITURE = "BODY", "FURNITURE"
#: Fixed value: the number of a numbered heading.
NUMBERED = r"(?U)\A\s*(\d+(?:\.\d+)*)\.?\s+\S"
TEXT_LABELS = ("text", "paragraph", "section_header", "caption", "list_item")
#: How captions of tables and figures begin.
TABLE_CAPTION = r"(?i)\A(?:tabelle|tab\.|table)\s*\d+"
FIGURE_CAPTION = r"(?i)\A(?:abbildung|abb\.|bild|figure|fig\.)\s*\d+"


def top_left(bbox: Column, height: Column) -> Column:
    """A bottom-left box seen from the top left corner."""
    return F.struct(bbox["l"].alias("l"), (height - bbox["t"]).alias("t"), bbox["r"].alias("r"), (height - bbox["b"]).alias("b"))


def area_fraction(bbox: Column, width: Column, height: Column) -> Column:
    """The share of the page that a box takes; unknown places count as the whole page."""
    w, h = F.abs(bbox["r"] - bbox["l"]), F.abs(bbox["t"] - bbox["b"])
    return F.coalesce(F.when((width > 0) & (height > 0), w * h / (width * height)), F.lit(1.0))


def prefix_furniture(items: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Body items whose trimmed text starts with one of ``prefixes`` become furniture."""
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | strip(F.col("text")).startswith(p)
    return items.withColumn("layer", F.when((F.col("layer") == BODY) & starts, FURNITURE).otherwise(F.col("layer")))


def repeated_keys(items: DataFrame, page: str = "page_no", keys: Sequence[str] = ("doc_id",), min_pages: int = 3, min_length: int = 4) -> DataFrame:
    """(keys.., key, pages) of texts that occur on ``min_pages`` pages or more."""
    keyed = items.withColumn("key", furniture_key(F.col("text"))).filter(F.length("key") >= min_length)
    return keyed.groupBy(*keys, "key").agg(F.count_distinct(page).alias("pages")).filter(F.col("pages") >= min_pages)


def repeated_furniture(items: DataFrame, min_pages: int = 3, band: float = 0.12) -> DataFrame:
    """Body text in the page margins that repeats on ``min_pages`` pages becomes furniture; 0 turns it off.

    All text counts for the pages, only body text moves.
    """
    if min_pages <= 0:
        return items
    repeated = repeated_keys(items.filter(F.col("label").isin(*TEXT_LABELS)), min_pages=min_pages).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    box = top_left(F.col("bbox"), F.col("page_h"))
    in_band = (F.col("page_h") > 0) & ((box["b"] <= F.col("page_h") * band) | (box["t"] >= F.col("page_h") * (1 - band)))
    joined = items.join(repeated, (F.col("doc_id") == F.col("_doc")) & (furniture_key(F.col("text")) == F.col("_key")), "left")
    moves = F.col("_key").isNotNull() & (F.col("layer") == BODY) & F.col("label").isin(*TEXT_LABELS) & F.coalesce(in_band, F.lit(False))
    return joined.withColumn("layer", F.when(moves, FURNITURE).otherwise(F.col("layer"))).drop("_doc", "_key")


def heading_levels(headings: DataFrame, partition: str = "doc_id", order: str = "pos") -> DataFrame:
    """Adds ``new_level`` to headings (text, level).

    A numbered heading is as deep as its number; another is one below the last
    numbered one, 6 at most, or keeps its level where there is none yet.
    """
    number = F.regexp_extract("text", NUMBERED, 1)
    numbered = F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    so_far = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    parent = F.last(numbered, ignorenulls=True).over(so_far)
    return headings.withColumn("new_level", F.coalesce(numbered, F.when(parent.isNotNull(), F.least(parent + 1, F.lit(6))), F.col("level")))


def breadcrumbs(items: DataFrame, partition: str = "doc_id", order: str = "pos", level: str = "level") -> DataFrame:
    """Adds ``breadcrumb``: the open headings above each item; a heading closes those as deep or deeper."""
    so_far = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("label") == "section_header"
    at, text = [], []
    for k in range(1, 7):
        here = heading & (F.col(level) == k)
        at.append(F.max(F.when(here, F.col(order))).over(so_far))
        text.append(F.last(F.when(here, F.col("text")), ignorenulls=True).over(so_far))
    crumbs = []
    for k in range(6):
        open_ = at[k].isNotNull()
        for above in range(k):
            open_ = open_ & (at[above].isNull() | (at[above] < at[k]))
        crumbs.append(F.when(open_, text[k]))
    return items.withColumn("breadcrumb", F.filter(F.array(*crumbs), lambda x: x.isNotNull()))


def nearby_caption(pattern: str, text: str = "text", label: str = "label", partition: str = "doc_id", order: str = "pos", max_length: int = 200) -> Column:
    """The first of the items after, before and two after that looks like a caption."""
    w = W.partitionBy(partition).orderBy(order)

    def guarded(shift):
        t = squeeze(shift(F.col(text)))
        return F.when(shift(F.col(label)).isin(*TEXT_LABELS) & t.rlike(pattern) & (F.length(t) < max_length), t)

    return F.coalesce(guarded(lambda c: F.lead(c, 1).over(w)), guarded(lambda c: F.lag(c, 1).over(w)), guarded(lambda c: F.lead(c, 2).over(w)))


def continued_captions(tables: DataFrame, partition: str = "doc_id", order: str = "pos") -> DataFrame:
    """Adds ``caption`` and ``inferred`` to tables (header, explicit, nearby).

    A table has its own caption, else that of the table before it if both have
    the same header, else a nearby one.
    """
    w = W.partitionBy(partition).orderBy(order)
    previous = F.lag("header").over(w)
    breaks = previous.isNull() | (F.col("header") == "") | (F.col("header") != previous)
    runs = tables.withColumn("_run", F.sum(F.when(breaks, 1).otherwise(0)).over(w))
    in_run = W.partitionBy(partition, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # Before any explicit caption, the run's caption is the first nearby one.
    found = F.coalesce(F.last("explicit", ignorenulls=True).over(in_run), F.first("nearby", ignorenulls=True).over(in_run))
    return runs.withColumn("caption", found).withColumn("inferred", F.col("explicit").isNull() & F.col("caption").isNotNull()).drop("_run")


def dehyphenate_cells(cells: DataFrame) -> DataFrame:
    """Cells with wrapped words joined; ``changed`` says which."""
    fixed = cells.withColumn("_fixed", dehyphenate(F.col("text")))
    return fixed.withColumn("changed", F.col("_fixed") != F.col("text")).withColumn("text", F.col("_fixed")).drop("_fixed")


def markdown(items: DataFrame) -> DataFrame:
    """(doc_id, markdown): body items in order, headings by level, page breaks between pages."""
    hashes = F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(1)))
    line = F.when(F.col("label") == "section_header", F.concat_ws(" ", hashes, F.col("text"))).when(F.col("label") == "picture", F.lit("<!-- image -->")).otherwise(F.col("text"))
    w = W.partitionBy("doc_id").orderBy("pos")
    turned = F.col("page_no") > F.lag("page_no").over(w)
    rows = items.filter(F.col("layer") == BODY).withColumn("_line", F.concat(F.when(turned, F.lit("<!-- page break -->\n\n")).otherwise(F.lit("")), line))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda x: x["_line"]), "\n\n").alias("markdown"))
