"""Stupid-backoff scores from n-gram counts of the whole corpus.

A block is a run of whole texts of one task, written before it is used.  It
explodes its texts into n-grams and keeps each distinct one once, dealt by hash
into buckets.  The count table of a bucket sums the blocks' counts, and is
joined back to the blocks' n-grams.  Each block then looks its n-grams up by
place and sums the scores of each document.  What is shuffled are rows that
pack the n-grams of a block in one bucket; a block has rows only for buckets
that it has n-grams in, so there are never more rows than distinct n-grams of
blocks, and a frequent n-gram has one entry a block, however often it occurs.

The score of a word is ln(c(n-gram) / c(context)) for the longest n-gram that
occurs elsewhere, with ln(``backoff``) for each word of context given up; the
document's own occurrences are left out of all counts, so copies of a text in
other documents raise its score and the text itself does not.  A word that
occurs nowhere else counts as seen half a time.  Contexts do not reach over
the beginning of a text.

A text without words, or null, has n_words 0 and null scores.  Rows are scored
one by one: equal rows count as different documents.  Only doc_id and text are
read; words are separated by white space, A-Z lowered.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize, mix64, text_blocks, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block.
BLOCK = 8 << 20
#: Packed rows that are handed over at once.
ROWS = 256
#: Bits of an n-gram's hash that are kept beside its bucket.
BITS = 56

_C = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def ngrams(hashes: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: the hash of the n-gram that ends at each word, and whether it lies within its text."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for n in range(1, order + 1):
        h = np.full(len(hashes), np.uint64(n), np.uint64)
        for j in range(n):
            h[n - 1 :] += hashes[n - 1 - j : len(hashes) - j] * _C[j]
        out.append((mix64(h) >> np.uint64(64 - BITS), place >= n - 1))
    return out


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending numbers as gaps, by planes of bytes, compressed."""
    import zstandard

    gaps = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending hashes: buckets are ranges of equal width."""
    edges = (np.arange(buckets, dtype=np.float64) / buckets * (1 << BITS)).astype(np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Block:
    """Consecutive rows of one task: ids and the texts' bytes."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def payload(self) -> bytes:
        import pickle

        import zstandard

        return zstandard.compress(pickle.dumps((self.ids, self.offsets, self.data.tobytes())), 3)

    def counted(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each n: the distinct n-grams' hashes, ascending, and their counts in the block."""
        hashes, _, _, first = word_hashes(self.data, self.offsets)
        return [np.unique(h[ok], return_counts=True) for h, ok in ngrams(hashes, first, order)]


def open_block(payload: bytes) -> Block:
    import pickle

    import zstandard

    ids, offsets, data = pickle.loads(zstandard.decompress(payload))
    return Block(ids, np.frombuffer(data, np.uint8), offsets)


def blocks(batches, size: int):
    """The blocks of a task; a block ends where ``size`` bytes are reached or a batch ends it."""
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    held_bytes = 0

    def join():
        ids = [i for h in held for i in h[0]]
        lengths = np.concatenate([np.diff(h[2]) for h in held])
        return Block(ids, np.concatenate([h[1] for h in held]), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64))

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for at, data, offsets in text_blocks(batch.column("text"), size // 4):
            held.append((ids[at : at + len(offsets) - 1], data.copy(), offsets))
            held_bytes += len(data)
            if held_bytes >= size:
                yield join()
                held, held_bytes = [], 0
    if held:
        yield join()


BLOCKS = "block string, payload binary, bytes bigint"
EXPLODED = "block string, bucket int, hashes array<binary>, counts array<binary>"
COUNTED = "block string, bucket int, payload binary, totals array<binary>, words bigint"


def count_bucket(table: pa.Table) -> pa.Table:
    """The count table of a bucket, joined to the blocks' n-grams: for each block the totals of its n-grams in their order."""
    names = table.column("block").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    hashes, counts = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
    totals: list[list[bytes]] = [[] for _ in names]
    words = 0
    for n in range(len(hashes[0]) if hashes else 0):
        keys = [unpack(h[n]) for h in hashes]
        sizes = np.cumsum([0, *map(len, keys)])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack_counts(c[n]) for c in counts]), len(every)).astype(np.uint64)
        if n == 0:
            words = int(total.sum())
        found = total[place]
        for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
            totals[i].append(pack_counts(found[a:b]))
    columns = [pa.array(names), pa.array([bucket] * len(names), pa.int32()), pa.array([None] * len(names), pa.binary()), pa.array(totals, pa.list_(pa.binary())), pa.array([words if i == 0 else 0 for i in range(len(names))], pa.int64())]
    return pa.table(columns, names=["block", "bucket", "payload", "totals", "words"])


def own_counts(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """How often each position's n-gram occurs in its own document."""
    _, place, counts = np.unique(doc * np.int64(n) + gram, return_inverse=True, return_counts=True)
    return counts[place]


def score_block(block: Block, totals: list[np.ndarray], n_words: int, order: int, backoff: float):
    """(words, summed scores) of each document of a block."""
    hashes, _, _, first = word_hashes(block.data, block.offsets)
    doc = np.repeat(np.arange(len(block.ids)), np.diff(first))
    sizes = np.diff(first)
    grams = ngrams(hashes, first, order)
    elsewhere = []
    for (h, ok), total in zip(grams, totals):
        every, place = np.unique(h[ok], return_inverse=True)
        c = np.zeros(len(h), np.float64)
        c[ok] = total[place] - own_counts(doc[ok], place, len(every) + 1)
        elsewhere.append(c)
    others = np.maximum(n_words - sizes[doc], 1)
    score = np.log(np.maximum(elsewhere[0], 0.5) / others) if len(doc) else np.zeros(0)
    given_up = np.minimum(np.arange(len(doc)) - first[:-1][doc], order - 1)
    for n in range(1, order):
        seen = grams[n][1] & (elsewhere[n] > 0)
        before = np.roll(elsewhere[n - 1], 1)
        score[seen] = np.log(elsewhere[n][seen] / before[seen])
        given_up[seen] = np.minimum(given_up[seen], np.minimum(np.arange(len(doc)) - first[:-1][doc], order - 1)[seen] - n)
    return sizes, np.bincount(doc, score + given_up * np.log(backoff), len(block.ids)) if len(doc) else np.zeros(len(block.ids))


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_words, score (natural logarithm, summed), mean_score."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")

    def written(batches):
        for block in blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([block.payload()], pa.binary()), pa.array([len(block.data)], pa.int64())], ["block", "payload", "bytes"])

    stored = materialize(rows.mapInArrow(written, BLOCKS), "lm-blocks")
    size = stored.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, size // block_bytes)

    def explode(batches):
        for batch in batches:
            for name, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                counted = open_block(payload.as_py()).counted(order)
                edges = [bounds(keys, buckets) for keys, _ in counted]
                some = np.flatnonzero(np.any([np.diff(e) for e in edges], axis=0))
                for i in range(0, len(some), ROWS):
                    chunk = some[i : i + ROWS].tolist()
                    hashes = [[pack(keys[e[b] : e[b + 1]]) for (keys, _), e in zip(counted, edges)] for b in chunk]
                    counts = [[pack_counts(c[e[b] : e[b + 1]]) for (_, c), e in zip(counted, edges)] for b in chunk]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(chunk)), pa.array(chunk, pa.int32()), pa.array(hashes, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.binary()))],
                        ["block", "bucket", "hashes", "counts"],
                    )

    counted = materialize(stored.select("block", "payload").mapInArrow(explode, EXPLODED).groupBy("bucket").applyInArrow(count_bucket, COUNTED), "lm-counts")
    n_words = counted.agg(F.sum("words")).first()[0] or 0

    def run(table: pa.Table) -> pa.Table:
        bucket = np.array(table.column("bucket").to_pylist())
        order_of = np.argsort(bucket, kind="stable")
        block = open_block(table.column("payload")[int(order_of[0])].as_py())
        found = [table.column("totals")[int(i)].as_py() for i in order_of[1:]]
        totals = [np.concatenate([np.zeros(0), *(unpack_counts(f[n]) for f in found)]).astype(np.float64) for n in range(order)]
        words, scores = score_block(block, totals, n_words, order, backoff)
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64(), mask=words == 0)], names=["doc_id", "n_words", "score"])

    texts = stored.select("block", F.lit(-1).cast("int").alias("bucket"), "payload", F.lit(None).cast("array<binary>").alias("totals"), F.lit(0).cast("bigint").alias("words"))
    scored = counted.unionByName(texts).groupBy("block").applyInArrow(run, "doc_id bigint, n_words bigint, score double")
    return scored.withColumn("mean_score", F.col("score") / F.col("n_words"))
