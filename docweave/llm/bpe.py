"""Byte-level BPE by DuckDB recursive queries in each partition.

A text is split by a pattern.  Each distinct piece that a task has not met yet
becomes rows (word, position, token), one for each byte.  A recursive query
joins neighbouring tokens to the merge table and contracts in each word the
leftmost pair of the least rank, until no pair is left.  It keeps all rounds, so
pieces are batched by the rows that they can come to, and those of over LONG
bytes are contracted in the same order by a heap.  Decoding looks the bytes up
of the very ids that a text's row returns, in their order.

Null text counts as empty: no tokens.  Equal rows give equal results, texts of
any length are encoded whole, and only doc_id and text are read.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import begins, keeps

#: Pieces in each of the two generations that a Python worker remembers; the older one goes when the younger is full.
MEMORY = 400_000
#: Pieces in one recursive query.
AT_ONCE = 20_000
#: Rows that the rounds of one recursive query come to at most, and the longest piece in it, in bytes.
ROWS = 4_000_000
LONG = 1_000

#: Characters of text in one round of splitting.
ROUND = 1 << 20

QUERY = """
WITH RECURSIVE step(round, word, pos, token) AS (
  SELECT 0, word, pos, token FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT round, word, pos, token, lead(token) OVER w AS right_token, lead(pos) OVER w AS right_pos
     FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)),
   best AS (  -- the least rank, then the leftmost place, of each word that has a pair to merge
     SELECT word, min((made::BIGINT << 32) | pos) AS hit, arg_min(right_pos, (made::BIGINT << 32) | pos) AS gone
     FROM pairs JOIN merges ON pair = (token::BIGINT << 32) | right_token GROUP BY word)
   SELECT round + 1, word, pos, CASE WHEN pos = hit & 4294967295 THEN (hit >> 32)::INT ELSE token END
   FROM pairs JOIN best USING (word) WHERE pos <> gone)
),
fixpoint AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT word, string_agg(token::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(bytes, '' ORDER BY pos) AS text
FROM step JOIN fixpoint USING (word, round) JOIN vocab USING (token) GROUP BY word
"""


class Codec:
    """Encodes and decodes with one rank file; lives in its Python worker until another operator begins there."""

    def __init__(self, path: str, pattern: str, memory: int | None = None):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        vocab = pa.table({"token": pa.array([t for _, t in tokens], pa.int32()), "bytes": pa.array([b.hex() for b, _ in tokens])})
        left_right = [(self.ranks[b[:i]], self.ranks[b[i:]], t) for b, t in tokens for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        triples = np.array(left_right, np.int64).reshape(-1, 3)
        merges = pa.table({"pair": triples[:, 0] * (1 << 32) + triples[:, 1], "made": triples[:, 2].astype(np.int32)})
        for name, table in (("vocab", vocab), ("merges", merges)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.of_byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.memory = memory or MEMORY
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: The bytes of each id, by its decimal form.
        self.bytes_of = {str(t): b for b, t in tokens}

    def learn(self, pieces: list[str]) -> None:
        """Adds the ids (decimal, comma-joined) of new pieces."""
        raw = [p.encode() for p in pieces]
        for p, b in zip(pieces, raw):
            if b in self.ranks:  # a piece that is a token is encoded as that token
                self.known[p] = str(self.ranks[b])
            elif len(b) > LONG:
                self.known[p] = ",".join(map(str, self.contract(b)))
        pieces, raw = [p for p in pieces if p not in self.known], [b for p, b in zip(pieces, raw) if p not in self.known]
        at = rows = 0
        for i, b in enumerate(raw):
            rows += len(b) * (len(b) + 1) // 2
            if rows > ROWS:
                self.recurse(pieces[at:i], raw[at:i])
                at, rows = i, len(b) * (len(b) + 1) // 2
        self.recurse(pieces[at:], raw[at:])

    def contract(self, raw: bytes) -> list[int]:
        """The tokens of a long piece: the leftmost pair of the least rank is merged until none is left."""
        n = len(raw)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if ends[i] != middle or ends[middle] != end:  # one of the two has been merged since
                continue
            ends[i], ends[middle], before[end] = end, -1, i
            for a, b in ((before[i], i), (i, end)):
                if a >= 0 and b < n and (r := self.ranks.get(raw[a : ends[b]])) is not None:
                    heapq.heappush(heap, (r, a, b, ends[b]))
        at, out = 0, []
        while at < n:
            out.append(self.ranks[raw[at : ends[at]]])
            at = ends[at]
        return out

    def recurse(self, pieces: list[str], raw: list[bytes]) -> None:
        if not raw:
            return
        lengths = np.array([len(b) for b in raw])
        first = np.cumsum(lengths) - lengths
        words = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        positions = (np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.int32)
        tokens = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        self.db.register("pieces", pa.table({"word": words, "pos": positions, "token": tokens}))
        got = self.db.execute(QUERY).fetchall()
        self.db.unregister("pieces")
        for word, ids, _ in got:
            self.known[pieces[word]] = ids

    def run(self, texts: list[str]) -> tuple[list[int], list[str], list[bytes]]:
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        split = [self.split(t) for t in texts]
        new = {p for ps in split for p in ps if p not in self.known}
        met = new & self.older.keys()
        self.known.update((p, self.older[p]) for p in met)
        rest = list(new - met)
        for i in range(0, len(rest), AT_ONCE):
            self.learn(rest[i : i + AT_ONCE])
        ids = [",".join(map(self.known.__getitem__, ps)) for ps in split]
        return [x.count(",") + bool(x) for x in ids], ids, [self.decoded(x) for x in ids]

    def decoded(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str, memory: int | None = None) -> Codec:
    return Codec(path, pattern, memory)


def codec(path: str, pattern: str, memory: int | None = None) -> Codec:
    keeps("bpe", _codec.cache_clear)
    return _codec(path, pattern, memory)


def rounds(texts: list[str]):
    """Slices of ``texts`` of about ROUND characters, or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > ROUND:
            yield texts[at:i], at
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:], at


def encode_decode(docs: DataFrame, path: str, pattern: str, memory: int | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (decimal, comma-joined), decoded (the ids' bytes).

    ``memory`` is the number of pieces that a worker remembers in a generation;
    fewer take less memory and more time, and the result is the same.
    """

    def run(batches):
        begins("bpe")
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for some, at in rounds(texts):
                n, ids, decoded = codec(path, pattern, memory).run(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(some)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids string, decoded binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids) to (doc_id, decoded): the tokens' bytes in the ids' order; null ids count as none."""

    def run(batches):
        begins("bpe")
        for batch in batches:
            c = codec(path, pattern)
            ids = batch.column("ids").to_pylist()
            split = [[int(x) for x in s.split(",")] if s else [] for s in ids]
            lengths = np.array([len(s) for s in split], np.int64)
            c.db.register("given", pa.table({
                "doc": np.repeat(np.arange(len(ids)), lengths),
                "pos": np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, np.int64)]).astype(np.int64),
                "token": np.array([x for s in split for x in s], np.int32),
            }))
            got = dict(c.db.execute("SELECT doc, string_agg(bytes, '' ORDER BY pos) FROM given JOIN vocab USING (token) GROUP BY doc").fetchall())
            c.db.unregister("given")
            out = [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
