"""MinHash near-dedup by an inverted join of signature coordinates.

A document is the set of its distinct word shingles; a text with fewer words
is one shingle, a text without words is empty and is linked with nothing.
Documents of one set form a class.  A class posts its id under each pair
(coordinate, value) of its MinHash signature.  Two classes are candidates if
at least ``matches`` coordinates collide.  As in prefix filtering and skip
merging, postings that nobody shares are skipped, classes that share too few
are left out, and of the m shared postings of a class only the m - matches + 1
rarest are merged: a pair with enough collisions meets in one of these.
Pairs that meet must also agree in enough of many more coordinates, of which
two bits each are kept.  The collisions of those left are counted, pairs below
``matches`` go, and the others are confirmed on their full sets.

In a merged list, members are first compared with the list's smallest id
only, over and over with one id a component, and last with all members of
other components.  So lists of thousands of near copies make few pairs, and no
pair is left out unless both are already known to be in one component.

Null text counts as empty; equal rows fall into one class.  Only doc_id and
text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import begins, join_checked, materialize, mix64, text_blocks, without_ids, word_hashes
from docweave.llm.components import components

SHINGLE = 5
COORDINATES = 64
#: Coordinates of the finer sketches, two bits of each, with which candidates are sifted before their sets are compared.
FINE = 1024
#: Words of 32 such coordinates that are compared while lists are joined.
FIRST = 16
#: Ids of candidate classes up to this number are broadcast to fetch their texts.
MAX_BROADCAST = 500_000
#: Rounds of comparing with one id a component before all pairs of components are met.
STAR_ROUNDS = 1

_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Yields for each text its sorted array of distinct shingle hashes."""
    for _, data, offsets in text_blocks(column):
        hashes, _, _, first = word_hashes(data, offsets)
        n = len(hashes)
        if n >= k:
            rolled = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                rolled += hashes[j : n - k + 1 + j] * _MULTIPLIERS[j]
            rolled = mix64(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:  # the whole sequence, told apart from others by its length
                with np.errstate(over="ignore"):
                    yield mix64((hashes[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, block: int = 4096) -> np.ndarray:
    """The minimum of each coordinate's hash over the set, as 32 bits."""
    a = _MULTIPLIERS_FOR(coordinates)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        x = shingles[None, i : i + block] ^ a[:, 1:]
        np.multiply(x, a[:, :1], out=x)
        np.minimum(least, x.min(axis=1), out=least)
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


_tables: dict[int, np.ndarray] = {}


def _MULTIPLIERS_FOR(n: int) -> np.ndarray:
    if n not in _tables:
        x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(n, 2)
        x[:, 0] |= np.uint64(1)
        _tables[n] = x
    return _tables[n]


def matches_needed(coordinates: int, percent: int) -> int:
    """So many collisions that a pair at the threshold falls short about once in ten million."""
    j = percent / 100
    return max(1, int(coordinates * j - 5.2 * (coordinates * j * (1 - j)) ** 0.5))


def sketch(docs: DataFrame, k: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, fp, signature): ``fp`` names the set, null for an empty one."""

    def run(batches):
        begins("minhash")
        for batch in batches:
            n, fps, sigs = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, coordinates).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "signature"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, fp binary, signature binary")


def postings(classes: DataFrame, coordinates: int) -> DataFrame:
    """(key, id) for each coordinate of each class; a key holds coordinate and value."""

    def run(batches):
        tag = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
                keys = (sigs.astype(np.uint64) | tag).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), coordinates))], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """The lowest two bits of FINE coordinates, packed into 64-bit words."""
    bits = signature(shingles, FINE) & np.uint32(3)
    place = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(bits.reshape(-1, 32).astype(np.uint64) << place, axis=1)


def fine_matches(percent: int, coordinates: int = FINE) -> int:
    """Fine coordinates that must agree; others agree by chance once in four."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(coordinates * p - 5.2 * (coordinates * p * (1 - p)) ** 0.5)


def _differ(x, y):
    """How many of the 32 coordinates in two words differ."""
    z = x.bitwiseXOR(y)
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def agree(percent: int):
    """Whether sketches a_.. and b_.. agree in enough of their first words, and their sizes allow a match."""
    total = F.lit(0)
    for i in range(FIRST):
        total = total + _differ(F.col(f"a_{i}"), F.col(f"b_{i}"))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * percent) & (total <= 32 * FIRST - fine_matches(percent, 32 * FIRST))


def agree_all(percent: int):
    differ = F.aggregate(F.zip_with("a_all", "b_all", lambda x, y: _differ(x, y)), F.lit(0), lambda s, x: s + x)
    return differ <= FINE - fine_matches(percent)


def sketch_columns(sets: DataFrame, side: str) -> DataFrame:
    words = [F.get("sketch", F.lit(i)).alias(f"{side}_{i}") for i in range(FIRST)]
    return sets.select(F.col("id").alias(side), F.size("shingles").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_all"), *words)


def collide(pairs: DataFrame, of_class: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) with at least ``matches`` collisions: keys of coordinate and value that both have."""
    a, b = (of_class.select(F.col("id").alias(x), F.transform("lists", lambda p: p["key"]).alias(f"keys_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").filter(F.size(F.array_intersect("keys_a", "keys_b")) >= matches).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    n, m = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").filter(both * 100 >= (n + m - both) * percent).select("a", "b")


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.expr(f"least({x}, {y}) AS a"), F.expr(f"greatest({x}, {y}) AS b"))


def near_components(docs: DataFrame, percent: int = 80, k: int = SHINGLE, coordinates: int = COORDINATES, shingled=shingle_sets) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included)."""
    matches = matches_needed(coordinates, percent)
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    sketched = materialize(sketch(docs, k, coordinates), "minhash-sketches")
    named = sketched.filter("fp IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")), "minhash-classes")
    posted = postings(classes, coordinates)
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    of_class = materialize(posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists")).filter(F.size("lists") >= matches), "minhash-lists")
    merged = of_class.select("id", F.explode(F.expr(f"slice(lists, 1, size(lists) - {matches - 1})")).alias("l")).select("id", F.col("l.key").alias("key"))
    merged = materialize(merged, "minhash-merged")
    fetched = join_checked(docs, of_class.select(F.col("id").alias("of")), F.col("doc_id") == F.col("of"), "left_semi", MAX_BROADCAST)

    def run(batches):
        begins("minhash")
        for batch in batches:
            sets = list(shingled(batch.column("text"), k))
            fine = [fine_sketch(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists_of(fine, pa.int64()), lists_of([s.view(np.int64) for s in sets], pa.int64())], ["id", "sketch", "shingles"])

    sets = materialize(fetched.mapInArrow(run, "id bigint, sketch array<bigint>, shingles array<bigint>"), "minhash-sets")

    links = labels = None
    for step in range(STAR_ROUNDS + 1):
        lists = merged.withColumn("c", F.col("id")) if labels is None else merged.join(labels, "id", "left").select("id", "key", F.coalesce("component", "id").alias("c"))
        # Lists whose members are all of one component have nothing left to find.
        order = F.struct("c", "id") if step == 0 else F.struct(F.xxhash64("id", F.lit(step)), "c", "id")
        heads = lists.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(order).alias("head")).filter("low < high")
        if step < STAR_ROUNDS:
            pairs = _ordered(lists.join(heads.select("key", "head"), "key").filter("c <> head.c"), "id", "head.id").distinct()
            pairs = pairs.join(sketch_columns(sets, "a"), "a").join(sketch_columns(sets, "b"), "b").filter(agree(percent)).filter(agree_all(percent)).select("a", "b")
        else:
            left = lists.join(heads.select("key"), "key", "left_semi").select("key", "id", "c")
            # Each pair is met in the first list that both have, once.
            own = left.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
            a = left.join(own, "id").join(sketch_columns(sets, "a"), F.col("id") == F.col("a"))
            a = a.select("key", "a", F.col("c").alias("a_c"), F.col("keys").alias("a_keys"), *[f"a_{x}" for x in ("n", "all", *range(FIRST))])
            b = a.withColumnsRenamed({c: "b" + c[1:] for c in a.columns if c != "key"}).withColumnRenamed("key", "b_key")
            once = F.get(F.array_intersect("a_keys", "b_keys"), F.lit(0)) == F.col("key")
            pairs = _ordered(a.join(b, (F.col("key") == F.col("b_key")) & (F.col("a_c") < F.col("b_c")) & agree(percent) & once).filter(agree_all(percent)), "a", "b")
        counted = materialize(collide(materialize(pairs, "minhash-pairs"), of_class, matches), "minhash-collisions")
        found = materialize(confirm(counted, sets, percent), "minhash-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = materialize(components(links), "minhash-components")

    member = named.select("doc_id", "fp").join(classes.select("fp", "id"), "fp")
    if labels is not None:
        member = member.join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    else:
        member = member.select("doc_id", F.col("id").alias("component_id"))
    rest = sketched.select("doc_id", "n_shingles")
    member = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("doc_id", "_of")
    return rest.join(member, F.col("doc_id") == F.col("_of"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest doc_id; empty texts all stay."""
    gone = near_components(docs, percent, **options).filter("component_id <> doc_id").select("doc_id").distinct()
    return without_ids(docs, materialize(gone, "minhash-gone"))
