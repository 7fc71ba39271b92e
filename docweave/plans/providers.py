"""Pluggable providers with deterministic offline defaults.

A provider is created once per Python worker.  Failures of single rows become
an error column where a stage may degrade; the embedder fails its stage.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replies after which a call is tried again.
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class CallError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        self.status = status
        super().__init__(f"status {status} {message}".strip())


def with_retries(call: Callable[[], object], attempts: int = 3, base_s: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Calls up to ``attempts`` times, waiting base, 2 base, 4 base, ..; the last error is raised as it is."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except (CallError, TimeoutError, ConnectionError) as e:
            if attempt == attempts or isinstance(e, CallError) and e.status not in RETRY_STATUS:
                raise
            sleep(base_s * 2 ** (attempt - 1))


class HashingEmbedder:
    """Signed word hashing, normalised: alike texts are near, and nothing is learnt or fetched."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def embed_batches(embedder: Embedder, texts: Sequence[str], batch: int, prefix: str = "") -> list[list[float]]:
    """Vectors in the order of the texts; wrong counts or dimensions are errors."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        some = [prefix + t for t in texts[i : i + batch]]
        vectors = embedder.embed(some)
        if len(vectors) != len(some):
            raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
        if any(len(v) != embedder.dim for v in vectors):
            raise ValueError(f"vectors are not of dimension {embedder.dim}")
        out += vectors
    return out


def embed(text: Column, factory: Callable[[], Embedder], batch: int = 64, prefix: str = "") -> Column:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = factory()
        for s in parts:
            yield pd.Series(embed_batches(embedder, [t or "" for t in s], batch, prefix))

    return run(text)


def describe(pictures: DataFrame, describer: Callable[[str, str], tuple[str, str]], min_area: float = 0.0) -> DataFrame:
    """Adds description and error to pictures (image, caption, area); a failure stays with its row.

    ``describer`` gives a text and how it ended; an empty or cut-off reply is an error.
    """

    @F.pandas_udf("description string, error string")
    def run(image: pd.Series, caption: pd.Series) -> pd.DataFrame:
        rows = []
        for i, c in zip(image, caption):
            try:
                text, ended = describer(i, c or "")
                rows.append((None, "cut off") if ended == "length" else (None, "empty reply") if not text.strip() else (text.strip(), None))
            except Exception as e:  # noqa: BLE001 - any provider failure degrades this picture only
                rows.append((None, str(e)[:200]))
        return pd.DataFrame(rows, columns=["description", "error"])

    big = F.col("image").isNotNull() & (F.col("area") >= min_area)
    done = pictures.withColumn("_d", F.when(big, run("image", "caption")))
    status = F.when(~big, "skipped").when(F.col("_d.error").isNotNull(), "error").otherwise("described")
    return done.withColumn("description", F.col("_d.description")).withColumn("error", F.col("_d.error")).withColumn("status", status).drop("_d")


def describe_report(described: DataFrame) -> DataFrame:
    return described.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("described", "skipped", "error")])


def extract_by_rules(chunks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The offline extractor: (doc_id, class, label, chunk_id) of identifiers that match a class's pattern."""
    found = F.array(*[F.struct(F.lit(c).alias("class"), F.regexp_extract_all("body", F.lit(f"({p})"), F.lit(1)).alias("labels")) for c, p in patterns.items()])
    rows = chunks.select("doc_id", "chunk_id", F.explode(found).alias("f"))
    return rows.select("doc_id", F.col("f.class").alias("class"), F.explode("f.labels").alias("label"), "chunk_id").distinct()
