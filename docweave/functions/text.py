"""Column functions on text: match keys, furniture keys, splits, evidence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics that a person's key may be stripped of.
TITLES = r"^(?:(?:dr|prof|dipl\.?-ing|mag|herr|frau|hr|fr)\.?\s+)+"
SPACE = r"(?U)[\s\x1c-\x1f]+"


def fold(x: Column) -> Column:
    """Case folding as far as it matters here: lower case, and ß as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, rf"\A{SPACE}|{SPACE[4:]}\z", "")


def squeeze(x: Column) -> Column:
    """White space runs, no-break spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def norm_key(x: Column, strip_titles: bool = False) -> Column:
    """Key for matching: squeezed, without trailing ``.,;:``, optionally without titles, folded."""
    key = F.regexp_replace(squeeze(x), r"[.,;:]+\z", "")
    if strip_titles:
        key = F.regexp_replace(key, "(?iU)" + TITLES, "")
    return fold(key)


def furniture_key(x: Column) -> Column:
    """Key under which repeated page furniture is alike: digit runs count as ``#``."""
    return fold(F.regexp_replace(squeeze(x), r"(?U)\d+", "#"))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def evidence(quote: Column, qualifier: Column) -> Column:
    """Quote and qualifier joined by a space; blank parts are left out."""
    return F.concat_ws(" ", blank_to_null(quote), blank_to_null(qualifier))


def caption_reference(caption: Column) -> Column:
    """What stands before the first colon."""
    return strip(F.split_part(caption, F.lit(":"), F.lit(1)))


def contextualize(headings: Column, body: Column) -> Column:
    return F.array_join(F.concat(headings, F.array(body)), "\n")


def sentences(x: Column) -> Column:
    return F.split(x, r"(?U)(?<=[.!?;:])\s+")


#: Conjunctions after a suspended hyphen.
CONJUNCTIONS = ("und", "oder", "bzw", "sowie", "beziehungsweise")


def dehyphenate(cell: Column) -> Column:
    """Closes the gap in ``word- word`` unless a conjunction follows, as after suspended hyphens.

    The cell is cut at its gaps, and each piece says by its first word, and by
    the end of the piece before it, whether its gap is closed.
    """
    pieces = F.split(cell, "- ")

    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def glued(piece: Column, last: Column) -> Column:
        first = F.regexp_extract(piece, r"(?U)\A\w+", 0)
        closes = last.rlike(r"(?U)\w\z") & (first != "") & ~first.isin(*CONJUNCTIONS)
        return F.concat(F.when(last.isNull(), "").when(closes, "-").otherwise("- "), piece)

    return F.array_join(F.zip_with(pieces, before, glued), "")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")


def tokens(x: Column) -> Column:
    """The offline tokenizer: runs of letters and digits, and single other marks."""
    return F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1))


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
