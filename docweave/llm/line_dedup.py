"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words (A-Z lowered).  Lines with equal sets
form a class, which is represented by its first line in the order of doc_id
and place.  Each class's words are ordered by rarity, and only its rarest ones,
the prefix, are joined: two sets whose Jaccard similarity reaches the threshold
share a word of both prefixes.  Length and positional filters thin the joined
pairs, and the rest is verified on the full sets.  A line goes if an earlier
line, whether that one stays or not, is similar enough; so of equal lines the
first stays.

Rarity is the count of a word's hash bucket over all documents; any fixed
order gives the same result, and the table of buckets has a fixed size.  Before
the join, each line is compared with two lines under each of its rarest words
and under words in long lists, so the lines of near copies have mostly gone.  Then only lines that
still stay are compared with all earlier ones: a group of near copies makes few
pairs, and no match of a line that stays is missed.

Words are separated by white space and in lower case.  Lines end at \\n.  Blank
lines have no words and stay.  A null text stays null, an empty one empty.  Rows
of equal doc_id (null is one such id) share the line numbers that go: a line
that has an earlier similar line in one of them goes from all of them.
Columns other than doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, join_checked, materialize, scratch

#: Hash buckets of the rarity table.
BUCKETS = 1 << 17
#: Steps of rarity for each doubling of a bucket's count; there are 127 at most.
STEPS = 4
#: Rarest words of a line under which it is compared with the first line.
HEAD_WORDS = 2
#: Lines, and four times the mean, from which on a hash bucket's lists count as long.
LONG_LIST = 200
#: Words of 64 bits in the wider bitmaps, a power of two.
SIFT = 4
#: Size classes span so many factors of 100/percent.
SIZES = 4
#: Ids of lines or documents that are broadcast, at most.
MAX_BROADCAST = 300_000


def tokens(text: Column, breaks: str = "\t\x0b\f\r") -> Column:
    """The words of a line in lower case, with an empty one for each space beside another."""
    for c in breaks:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(F.lower(text), " ")


def rarity(docs: DataFrame) -> list[int]:
    """For each hash bucket, STEPS times the binary logarithm of its words' count over all documents."""
    words = docs.select(F.explode(tokens(F.col("text"), "\n")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    table = [0] * BUCKETS
    for b, n in counts.select("b", F.least(F.floor(F.log2("count") * STEPS), F.lit(127)).cast("int")).collect():  # BUCKETS rows at most
        table[b] = int(n)
    return table


def middle(table: list[int]) -> int:
    """The least number of a word of medium rarity: about half of all words are rarer."""
    mass = [0.0] * 128
    for level in filter(None, table):  # empty buckets and words that occur once are both of level 0
        mass[level] += 2 ** (level / STEPS)
    below = 0.0
    for level, m in enumerate(mass):
        below += m
        if 2 * below >= sum(mass):
            return level << 51
    return 0


def numbers(line: Column, table: list[int]) -> Column:
    """The line's distinct words as numbers: rarity in the high bits, a 51-bit hash below."""
    levels = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one literal
    hashes = F.array_remove(F.array_distinct(F.transform(tokens(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    level = lambda h: F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("bigint")
    return F.transform(hashes, lambda h: F.shiftleft(level(h), 51).bitwiseOR(F.shiftrightunsigned(h, 13)))


def ranked(line: Column, table: list[int]) -> Column:
    """The line's words as numbers, the rarest first."""
    return F.sort_array(numbers(line, table))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, line) of all lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


@dataclass
class LineIds:
    """One orderable id for (doc_id, ln): a packed number where both fit, else the two as a struct."""

    shift: int | None

    @classmethod
    def of(cls, lines: DataFrame) -> LineIds:
        last, low, high = lines.agg(F.max("ln"), F.min("doc_id"), F.max("doc_id")).first()
        shift = max(1, int(last or 0).bit_length())
        fits = max(abs(low or 0), abs(high or 0)) < 1 << (62 - shift)
        return cls(shift if fits else None)

    def pack(self) -> Column:
        if self.shift is None:
            return F.struct("doc_id", "ln")
        doc = F.coalesce("doc_id", F.lit(-(1 << (62 - self.shift))).cast("bigint"))  # null is the least, as in a struct
        return F.shiftleft(doc, self.shift).bitwiseOR(F.col("ln").cast("bigint"))

    def unpack(self, column: str) -> list[Column]:
        if self.shift is None:
            return [F.col(f"{column}.doc_id").alias("doc_id"), F.col(f"{column}.ln").alias("ln")]
        doc = F.shiftright(column, self.shift)
        ln = F.col(column).bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int")
        return [F.when(doc != F.lit(-(1 << (62 - self.shift))), doc).alias("doc_id"), ln.alias("ln")]


def parity(words: Column) -> Column:
    """64 bits, of which each word flips one; so sets differ in as many words as their bits at least."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(bit(x)))


def bits_differ() -> Column:
    return F.bit_count(F.col("bits").bitwiseXOR(F.col("a_bits"))) + F.bit_count(F.col("more").bitwiseXOR(F.col("a_more")))


def similar_lines(docs: DataFrame, percent: int = 80, folder: str | None = None) -> DataFrame:
    """(doc_id, ln) of each line that has an earlier similar line.  ``folder`` holds the tables made on the way."""
    folder = folder or scratch("lines")
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    table = rarity(docs)
    # A mark among the sorted words parts rarer from more frequent ones, which flip bits of their own.
    # Blank lines are left out only when the lines are read again: a filter here would rank all words twice.
    mark = F.lit(middle(table)).cast("bigint")
    lines = lines_of(docs).withColumn("marked", F.sort_array(F.concat(numbers(F.col("line"), table), F.array(mark)))).withColumn("cut", F.array_position("marked", mark).cast("int"))
    n = F.size("marked") - 1
    rarer, rest = F.slice("marked", F.lit(1), F.col("cut") - 1), F.slice("marked", F.col("cut") + 1, n + 1)
    short = F.transform(F.slice(F.concat(rarer, rest), F.lit(1), n - part(n, percent) + 1), lambda x: x.bitwiseXOR(F.shiftright(x, 23)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    lines = lines.select("doc_id", "ln", F.xxhash64("marked").alias("f1"), F.xxhash64("marked", F.lit(1)).alias("f2"), n.alias("n"), parity(rarer).alias("bits"), parity(rest).alias("more"), short.alias("prefix"))
    lines = materialize(lines, f"{folder}/lines/all").filter("n > 0")
    ids = LineIds.of(lines)
    lines = lines.withColumn("id", ids.pack())
    classes = lines.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "bits", "more", "prefix")).alias("m"), F.count("*").alias("copies")).select("m.*", "f1", "f2", "copies")
    classes = materialize(classes, f"{folder}/classes")
    repeated = classes.filter("copies > 1").select(F.col("id").alias("first"), "f1", "f2")
    copies = join_checked(lines.select("id", "f1", "f2"), repeated, ["f1", "f2"], "inner", MAX_BROADCAST).filter("id <> first").select("id")
    copies = materialize(copies, f"{folder}/copies")
    discard(docs.sparkSession, f"{folder}/lines")

    differing = classes.filter(n_can_differ(F.col("n"), percent)).select("id", "n", "bits", "more", "prefix")
    near = with_heads(differing, percent, f"{folder}/head-pairs")
    gone = verify(near, sets_of(near, docs, ids, table, f"{folder}/heads"), percent, f"{folder}/found-heads")
    discard(docs.sparkSession, f"{folder}/heads")
    marked = join_checked(differing, gone.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left", MAX_BROADCAST).withColumn("open", F.col("of").isNull().cast("int")).drop("of")
    pairs = materialize(candidates(marked, percent), f"{folder}/pairs")
    words_of = sets_of(pairs, docs, ids, table, f"{folder}/pairs")
    # One similar line is enough: the likeliest one is tried first, and all others only where it is not.
    likely = pairs.groupBy("id").agg(F.min(F.struct("differ", "head")).alias("h")).select("id", "h.head")
    found = verify(likely, words_of, percent, f"{folder}/found-likely")
    rest = without(pairs.select("id", "head").distinct(), found)
    found = found.unionByName(verify(rest, words_of, percent, f"{folder}/found-rest"))
    return copies.unionByName(gone).unionByName(found).distinct().select(*ids.unpack("id"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return join_checked(rows, ids.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_anti", MAX_BROADCAST)


def part(n: Column, percent: float) -> Column:
    """The least whole number that is at least ``percent`` per cent of n."""
    return F.ceil(n * F.lit(percent / 100) - F.lit(1e-9)).cast("int")


def n_can_differ(n: Column, percent: int) -> Column:
    """Whether sets of n words can be similar to other sets: one word more or less must be allowed."""
    return (n * 100 >= percent * (n + 1)) | ((n - 1) * 100 >= percent * n)


def sizes_allow(percent: int, n: Column, m: Column) -> Column:
    """Bitmap and length filters of a pair; neither loses a similar one."""
    return (bits_differ() * (100 + percent) <= (100 - percent) * (n + m)) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def with_heads(rows: DataFrame, percent: int, name: str) -> DataFrame:
    """(id, head): lines, and two fixed members of the lists of their rarest words and of all words in long lists.

    Lines of near copies mostly go by this.  Their rarest words may be those in which they differ, but the words
    that they share make long lists.  Long lists are told by the number of lines in their hash bucket.
    """
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    filled = rows.select(F.explode("prefix").alias("word")).groupBy(bucket).count()
    least = LONG_LIST + 4 * (filled.agg(F.sum("count")).first()[0] or 0) // BUCKETS
    long = F.broadcast(settled_buckets(filled, least, name))  # BUCKETS rows at most
    posted = rows.select("id", "n", "bits", "more", F.posexplode("prefix").alias("pos", "word")).withColumn("in", bucket)
    posted = posted.join(long, F.col("in") == F.col("long"), "left").filter((F.col("pos") < HEAD_WORDS) | F.col("long").isNotNull()).select("id", "n", "bits", "more", "word")
    lists = posted.groupBy("word").agg(F.min("id").alias("h1"), F.min_by("id", F.xxhash64("id")).alias("h2"), F.count("*").alias("members")).filter("members > 1")
    met = posted.join(lists.select("word", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("head")), "word").filter("head < id").select("id", "n", "bits", "more", "head").distinct()
    heads = rows.select(F.col("id").alias("head"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("more").alias("a_more"))
    met = met.join(heads, "head").filter(sizes_allow(percent, F.col("n"), F.col("a_n")))
    return materialize(met.select("id", "head"), name)


def settled_buckets(filled: DataFrame, least: int, name: str) -> DataFrame:
    return materialize(filled.filter(F.col("count") > least).select(F.col("bucket").alias("long")), f"{name}-long")


def candidates(marked: DataFrame, percent: int) -> DataFrame:
    """(id, head, differ): pairs that share a word within their prefixes, the later one open, and pass the filters."""
    posted = marked.select("id", "n", "bits", "more", "open", F.posexplode("prefix").alias("pos", "word"))
    # The smaller set of a pair shares a word within a prefix that is shorter still.  Its size falls into the
    # larger one's class of sizes or, near the class's top, the one below, so it is posted for both there.
    step = F.lit(SIZES * math.log(100 / percent))
    own = F.floor(F.ln("n") / step + F.lit(1e-9))
    above = F.floor((F.ln("n") + math.log(100 / percent)) / step + F.lit(1e-6))
    packed = [
        F.shiftleft(F.col("sizes").cast("bigint"), 32).bitwiseOR(F.col("word").cast("bigint")).alias("at"),
        F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), 1)).bitwiseOR(F.col("open").cast("bigint")).alias("facts"),
        "bits", "more", "id",
    ]
    index = posted.filter(F.col("pos") <= F.col("n") - part(F.col("n"), 200 * percent / (100 + percent)))
    index = index.withColumn("sizes", F.explode(F.array_distinct(F.array(own, above)))).select(*packed)
    index = index.select([F.col(c).alias(f"a_{c}") for c in index.columns])
    probe = posted.withColumn("sizes", own).select(*packed)
    n, pos, open_ = unpacked("facts")
    m, a_pos, a_open = unpacked("a_facts")
    smaller = (m < n) | ((m == n) & (F.col("a_id") < F.col("id")))
    later_open = F.when(F.col("a_id") > F.col("id"), a_open).otherwise(open_) == 1
    shared = F.least(pos, a_pos) + F.least(n - pos, m - a_pos)
    in_place = shared * (100 + percent) >= percent * (n + m)
    pairs = index.hint("shuffle_hash").join(probe, (F.col("a_at") == F.col("at")) & later_open & sizes_allow(percent, n, m) & in_place & smaller)
    return pairs.select(F.greatest("id", "a_id").alias("id"), F.least("id", "a_id").alias("head"), bits_differ().alias("differ"))


def unpacked(facts: str) -> tuple[Column, Column, Column]:
    f = F.col(facts)
    return F.shiftright(f, 32).cast("int"), F.shiftright(f, 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"), f.bitwiseAND(F.lit(1))


def sets_of(pairs: DataFrame, docs: DataFrame, ids: LineIds, table: list[int], folder: str) -> DataFrame:
    """(id, words, n, bitmaps) of all lines in pairs (id, head), from the texts again."""
    wanted = pairs.select("id").union(pairs.select("head")).distinct().select(*ids.unpack("id")).groupBy("doc_id").agg(F.collect_set("ln").alias("wanted")).withColumnRenamed("doc_id", "of")
    rows = join_checked(docs, materialize(wanted, f"{folder}/wanted"), F.col("doc_id").eqNullSafe(F.col("of")), "inner", MAX_BROADCAST // 2)
    rows = rows.select("doc_id", "wanted", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(F.array_contains("wanted", F.col("ln")))
    words = rows.select(ids.pack().alias("id"), ranked(F.col("line"), table).alias("words"))
    return materialize(words.select("id", "words", F.size("words").alias("n"), *[flips("words", k).alias(f"b{k}") for k in range(SIFT)]), f"{folder}/sets")


def flips(words: str, k: int) -> Column:
    """The k-th 64 of the 64 * SIFT bits that the words flip."""
    return parity(F.filter(words, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(SIFT - 1)) == k))


def verify(pairs: DataFrame, words_of: DataFrame, percent: int, name: str) -> DataFrame:
    """(id) of the later lines of pairs (id, head) that are similar on their full sets.

    Wider bitmaps leave few pairs for which the sets themselves have to move.
    """
    facts = ["n", *[f"b{k}" for k in range(SIFT)]]
    a = words_of.select("id", *[F.col(c).alias(f"a_{c}") for c in facts])
    b = words_of.select(F.col("id").alias("head"), *facts)
    differ = F.lit(0)
    for k in range(SIFT):
        differ = differ + F.bit_count(F.col(f"a_b{k}").bitwiseXOR(F.col(f"b{k}")))
    sifted = pairs.join(a, "id").join(b, "head").filter(differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("a_n"))).select("id", "head")
    wa = words_of.select("id", F.col("words").alias("wa"))
    wb = words_of.select(F.col("id").alias("head"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    found = sifted.join(wa, "id").join(wb, "head").filter(both * (100 + percent) >= percent * (F.size("wa") + F.size("wb"))).select("id").distinct()
    return materialize(found, name)


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the lines that have an earlier similar line."""
    folder = scratch("lines")
    gone = similar_lines(docs, percent, folder).groupBy("doc_id").agg(F.collect_set("ln").alias("gone")).withColumnRenamed("doc_id", "of")
    gone = materialize(gone, "lines-gone")
    discard(docs.sparkSession, folder)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # its columns may have any names
    joined = join_checked(rows, gone, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("of")), "left", MAX_BROADCAST // 2)
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
