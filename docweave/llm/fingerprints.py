"""Document fingerprints by consistent weighted sampling.

A text's terms are its words in lower case, weighted by how often they occur.
For each of K coordinates every term draws r and c from Gamma(2, 1) and b from
[0, 1), all fixed by the term and the coordinate.  With weight w it offers
t = floor(ln w / r + b) at the value ln c - r (t - b + 1); the least offer of a
text is its sample (term, t).  Two texts share a sample with the probability
of the generalised Jaccard similarity of their weights, the sum of smaller
weights over the sum of larger ones, so the share of equal coordinates
estimates it.  Each offer is one number: its value, in order, in the high bits
and a hash of (term, t) in the low ones, so a coordinate is a plain minimum.

Null text counts as empty.  A text without words has the fingerprint ``-``,
which is like itself only.  Equal texts have equal fingerprints.  The next
document of a row is the one after it in the order of doc_id and, for equal
ids, of a hash of the text; after the last comes the first, and one row alone is
its own next.  Equal rows are one document, with a row for each copy.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import materialize

COORDINATES = 32


#: Coordinates computed in one pass over a row; a term has a row for each such group.
AT_ONCE = 8
KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): a key that no two different rows share, null ids first."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("k2"), "doc_id", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """Adds n1, n2, the key of the next row in the order of (k1, k2), to rows with unique keys; after the last comes the first.

    Rows are dealt by ranges of the key; a range's last row takes the first key
    of the next range that has any, from a table of one row a range.
    """
    dealt = materialize(rows.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "ordered")
    key = F.struct(*KEY)
    firsts = dealt.groupBy("range").agg(F.min(key).alias("first"))
    following = firsts.select(F.col("range").alias("of"), F.coalesce(F.lead("first").over(W.orderBy("range")), F.min("first").over(W.partitionBy())).alias("next_first"))
    inside = dealt.withColumn("next", F.lead(key).over(W.partitionBy("range").orderBy(*KEY)))
    joined = inside.join(F.broadcast(following), F.col("range") == F.col("of"))
    return joined.withColumn("next", F.coalesce("next", "next_first")).select(*rows.columns, F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"))


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def uniform(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from 31 bits of a hash."""
    return (F.shiftright(bits, shift).bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0.5)) * F.lit(1 / (1 << 31))


def packed(term: Column, ln_weights: list[Column], *coordinate: Column) -> list[Column]:
    """The offers of a term (a 64-bit hash) for each weight in one coordinate, as numbers.

    Values lie well within -2048 and 2048 and are kept to 2**-20.
    """
    one, two, three = (F.xxhash64(term, *coordinate, F.lit(i)) for i in range(3))
    r = -F.ln(uniform(one, 0) * uniform(one, 32))
    ln_c = F.ln(-F.ln(uniform(two, 0) * uniform(two, 32)))
    b = uniform(three, 0)
    out = []
    for ln_w in ln_weights:
        t = F.floor(ln_w / r + b)
        value = F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), ln_c - r * (t - b + 1)))
        low = F.xxhash64(term, t).bitwiseAND(F.lit(0x7FFFFFFF))
        out.append(F.shiftleft(F.floor((value + 2048) * (1 << 20)).cast("bigint"), 31).bitwiseOR(low))
    return out


def signatures(rows: DataFrame, columns: list[str], coordinates: int = COORDINATES) -> DataFrame:
    """(k1, k2) and for each text column an array of its samples, null without words.

    ``rows`` are dealt by (k1, k2), so neither aggregation moves a row.
    """
    texts = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(columns)])
    terms = rows.select(*KEY, F.explode(texts).alias("x")).select(*KEY, "x.i", F.explode(words(F.col("x.t"))).alias("w")).filter("w <> ''")
    weighed = terms.groupBy(*KEY, F.xxhash64("w").alias("term")).agg(*[F.count(F.when(F.col("i") == i, 1)).alias(f"w{i}") for i in range(len(columns))])
    weighed = weighed.select(*KEY, "term", *[F.when(F.col(f"w{i}") > 0, F.ln(f"w{i}")).alias(f"w{i}") for i in range(len(columns))])
    weighed = weighed.withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(-(-coordinates // AT_ONCE))])))
    least = []
    for j in range(AT_ONCE):
        offers = packed(F.col("term"), [F.col(f"w{i}") for i in range(len(columns))], F.col("g"), F.lit(j))
        least += [F.min(o).alias(f"m{i}_{j}") for i, o in enumerate(offers)]
    groups = weighed.groupBy(*KEY, "g").agg(*least)
    samples = [F.sort_array(F.collect_list(F.struct("g", F.array(*[F.col(f"m{i}_{j}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for j in range(AT_ONCE)]).alias("s")))) for i in range(len(columns))]
    arrays = groups.groupBy(*KEY).agg(*[s.alias(c) for s, c in zip(samples, columns)])
    flat = lambda c: F.slice(F.flatten(F.col(f"{c}.s")), 1, coordinates)
    return arrays.select(*KEY, *[F.when(F.get(flat(c), F.lit(0)).isNotNull(), flat(c)).alias(c) for c in columns])


def likeness(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    """The share of equal coordinates; two texts without words are alike, one without is like no other."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal / F.lit(float(coordinates)))


def as_text(sample: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sample, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit("-"))


def fingerprint(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """One row for each document: doc_id, fingerprint (an array of samples, null without words)."""
    rows = keyed(docs).dropDuplicates(KEY)
    signed = signatures(rows, ["text"], coordinates).withColumnsRenamed({"k1": "s1", "k2": "s2", "text": "fingerprint"})
    return keyed(docs).select(*KEY, "doc_id").join(signed, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("doc_id", "fingerprint")


def compare_edited(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has, in place of its last quarter of code points, rounded
    down, as many from the beginning of the next document, or all it has.
    Columns: doc_id, n_chars, edited_sha256, sample, edited, next_sample.
    """
    keys = keyed(docs).groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).cast("bigint").alias("n_chars"), F.count("*").alias("copies"))
    order = materialize(in_order(keys), "fingerprint-order")
    # Both joins below read the same exchange of the texts.
    texts = keyed(docs).select(*KEY, "text").dropDuplicates(KEY)
    wanted = order.select(F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.expr("CAST(n_chars div 4 AS INT)").alias("need"))
    begun = texts.select(*KEY, "text").join(wanted, KEY).select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.expr("substring(text, 1, need)").alias("begin"))
    cut = F.expr("substring(text, 1, CAST(length(text) - length(text) div 4 AS INT))")
    both = texts.join(begun, KEY).select(*KEY, "text", F.concat(cut, F.col("begin")).alias("edited"))
    facts = both.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    signed = signatures(both, ["text", "edited"], coordinates)
    table = materialize(facts.join(signed, KEY, "left").join(order, KEY), "fingerprints")
    following = table.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("text").alias("next_sample"))
    out = table.join(following, ["n1", "n2"]).withColumn("copy", F.explode(F.expr("sequence(1, CAST(copies AS INT))")))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text").alias("sample"), "edited", "next_sample")
