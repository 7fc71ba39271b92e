"""Toxicity from the nearest labelled examples.

A text's terms are its words (letters only, lower case).  A bounded sample of
labelled documents tells which features, among words, beginnings of words and
each of these met repeatedly, go with either label more often than chance
allows; such features are terms too.  The vocabulary is all words of the indexed
examples and all of these features; document frequencies come from all
documents.  A term weighs (1 + ln tf) * idf, times its relevance, which is 1 for
words that go with neither label and grows with the log-likelihood ratio for
others, so that a few telling words outweigh a long text about anything.

Each document is compared with the indexed examples, toxic and clean ones, by
exact cosine, through an inverted index whose postings are cut into blocks with
maximum weights: blocks that cannot reach the k best are skipped.  Votes
weighted by closeness, with a prior from the sample, and a logistic curve fitted
to examples that are left out in turn, give the score; the nearest examples and
the strongest terms are the evidence.

Null and empty texts, and texts without a known term, get the smoothed share of
toxic ones among examples without terms.  Without any usable label each score
is 0.5.  Repeated label rows of a document count once, as toxic if any is; of
several texts with one labelled id the least is the example.  Equal texts get
equal scores.  Only doc_id and text are read for a score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import begins, materialize, short_batches, without_ids

#: Labelled documents that tell relevance, at most; the choice is by a hash of doc_id.
MAX_EXAMPLES = 20_000
#: Examples of each label in the index, at most.
MAX_INDEXED = 1_000
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 6)
#: Log-likelihood ratio from which on a feature goes with a label; chance reaches it once in ten thousand.
RELEVANT = 16.0
#: Examples in a block of the inverted index.
BLOCK = 128
NEAREST = 15
#: Words whose features a worker remembers; beyond it begins anew.
KNOWN_WORDS = 150_000
#: Examples that the calibration scores, at most.
MAX_CALIBRATION = 3_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    found = [word + "$"]
    for n in BEGINNINGS:
        if len(word) >= n:
            found.append(word[:n])
    return found


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(batches, rows: int = 500):
    """Batches in pieces of few rows, so that a worker never holds the Python objects of many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def sample(labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """At most ``limit`` (doc_id, toxic) of documents that are not held out, by a hash of doc_id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def repeated(feature: str) -> str:
    return feature + "#2"


def presence(examples: DataFrame) -> DataFrame:
    """(feature, a, b): partial counts of the toxic and the clean examples (text, toxic) that have a feature."""

    def flush(counts):
        a, b = counts
        own = list(a.keys() | b.keys())
        columns = [pa.array(own, pa.string()), pa.array([a[f] for f in own], pa.int64()), pa.array([b[f] for f in own], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["feature", "a", "b"])

    def run(batches):
        begins("toxicity")
        counts = Counter(), Counter()
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own: Counter = Counter()
                for w, n in Counter(words(text)).items():
                    for f in features(w):
                        own[f] += n
                to = counts[0 if toxic else 1]
                to.update(own.keys())
                to.update(repeated(f) for f, n in own.items() if n > 1)
                if len(counts[0]) + len(counts[1]) > 50_000:
                    yield flush(counts)
                    counts = Counter(), Counter()
        yield flush(counts)

    return examples.select("text", "toxic").mapInArrow(run, "feature string, a bigint, b bigint")


def relevance(examples: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Features that go with either label beyond chance, and 1 + the root of their log-likelihood ratio."""
    counts = presence(examples).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n1, n0 = float(max(n_toxic, 1)), float(max(n_clean, 1))
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(F.col("a"), share * n1) + part(F.col("b"), share * n0) + part(n1 - F.col("a"), (1 - share) * n1) + part(n0 - F.col("b"), (1 - share) * n0))
    # The rows are features of at most MAX_EXAMPLES documents that pass; a toxic lean of next to nothing is none.
    apart = F.greatest(F.col("a") / n1, F.col("b") / n0) >= 4 * F.least(F.col("a") / n1, F.col("b") / n0)
    kept = counts.withColumn("ratio", ratio).filter((F.col("ratio") >= RELEVANT) & apart)
    return {r.feature: 1.0 + r.ratio**0.5 for r in kept.select("feature", "ratio").collect()}


def indexed_words(indexed: DataFrame) -> list[str]:
    """All words of the indexed examples, as features."""

    def run(batches):
        begins("toxicity")
        own: set[str] = set()
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                own.update(words(text))
        yield pa.RecordBatch.from_arrays([pa.array([w + "$" for w in own], pa.string())], ["feature"])

    return [r.feature for r in indexed.select("text").mapInArrow(run, "feature string").distinct().collect()]


def terms(rows: np.ndarray, ns: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, once: np.ndarray, again: np.ndarray):
    """(text, term, count), ordered, of a piece: ``sizes`` of its words belong to each text, ``rows`` to their features."""
    lengths = np.diff(starts, append=len(flat))
    n = lengths[rows]
    ends = np.cumsum(n)
    at = np.arange(int(n.sum())) + np.repeat(starts[rows] - (ends - n), n)
    key = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n) * len(once) + flat[at]
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    total = np.add.reduceat(np.repeat(ns, n)[order], first) if len(first) else np.zeros(0, np.int64)
    doc, feature = key // max(len(once), 1), key % max(len(once), 1)
    there, more = once[feature] >= 0, (again[feature] >= 0) & (total > 1)
    doc, term, count = (np.concatenate(x) for x in ((doc[there], doc[more]), (once[feature[there]], again[feature[more]]), (total[there], total[more] - 1)))
    order = np.lexsort((term, doc))
    return doc[order], term[order], count[order]


def vectors(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """(doc_id, features, counts): each whole text's features in the vocabulary and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        begins("toxicity")
        # Of each feature, the term that it is and the term of its being there again; -1 for none.
        base = {f: i for i, f in enumerate(dict.fromkeys(f.removesuffix("#2") for f in shared.value))}
        once, again = np.full((2, len(base)), -1, np.int64)
        none = np.zeros(0, np.int64)
        for i, f in enumerate(shared.value):
            (again if f.endswith("#2") else once)[base[f.removesuffix("#2")]] = i
        known: dict[str, int] = {}  # words to where their features are, -1 without one
        starts, flat = array("q"), array("q")
        for batch in pieces(batches):
            if len(known) > KNOWN_WORDS:
                known.clear()
                starts, flat = array("q"), array("q")
            rows, ns, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                own = Counter(words(text))
                for w in [w for w in own if w not in known]:
                    got = [base[f] for f in features(w) if f in base]
                    known[w] = len(starts) if got else -1
                    if got:
                        starts.append(len(flat))
                        flat.extend(got)
                found = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                there = found >= 0
                rows.append(found[there])
                ns.append(np.fromiter(own.values(), np.int64, len(own))[there])
                sizes.append(len(rows[-1]))
            doc, term, count = terms(np.concatenate([none, *rows]), np.concatenate([none, *ns]), np.array(sizes, np.int64), np.array(starts, np.int64), np.array(flat, np.int64), once, again)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "features", "counts"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, features array<int>, counts array<int>")


def frequencies(sparse: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of ``n`` features occurs; a task adds up its own before any row leaves it."""

    def run(batches):
        begins("toxicity")
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("features").flatten().to_numpy(), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["f", "n"])

    df = np.zeros(n)
    for r in sparse.select("features").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():  # a row for each feature at most
        df[r.f] = r.n
    return df


def weigh(ids, counts, weight: np.ndarray):
    ids = np.asarray(ids, np.int64)
    w = (1 + np.log(np.asarray(counts, np.float64))) * weight[ids] if len(ids) else np.zeros(0)
    return ids, w / (np.linalg.norm(w) or 1.0)


class BlockMaxIndex:
    """Exact k nearest examples by cosine; blocks that cannot reach them are skipped.

    ``examples`` are (doc_id, toxic, features, counts); ``weight`` is each feature's idf times its relevance.
    """

    def __init__(self, examples: list, weight: np.ndarray):
        self.weight = weight
        weighed = [(doc, toxic, *weigh(ids, counts, weight)) for doc, toxic, ids, counts in examples if len(ids)]
        weighed.sort(key=lambda x: (int(x[2][np.argmax(x[3])]), x[0]))  # alike examples share blocks
        self.ids = np.array([x[0] for x in weighed], np.int64)
        self.toxic = np.array([x[1] for x in weighed], np.float64)
        self.blocks = -(-len(weighed) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in weighed)])
        place = np.repeat(np.arange(len(weighed)), [len(x[2]) for x in weighed])
        ws = np.concatenate([np.zeros(0), *(x[3] for x in weighed)])
        order = np.lexsort((place, term))
        self.at, self.w = place[order].astype(np.int32), ws[order]
        block = term[order] * max(self.blocks, 1) + self.at // BLOCK
        cells = len(weight) * max(self.blocks, 1)
        # Postings of a term in a block are those between two neighbouring starts.
        self.starts = np.searchsorted(block, np.arange(cells + 1)).astype(np.int32)
        most = np.zeros(cells, np.float32)
        np.maximum.at(most, block, self.w.astype(np.float32))
        self.most = (np.nextafter(most, np.float32(2)) * (most > 0)).reshape(len(weight), max(self.blocks, 1))  # bounds stay above after rounding
        no = [t for _, t, ids, _ in examples if not len(ids)]
        self.n = len(examples)
        self.prior = sum(t for _, t, _, _ in examples) / self.n if self.n else 0.5
        self.bare = (sum(no) + self.prior) / (len(no) + 1) if self.n else 0.5
        self.curve = 1.0, 0.0
        self.cache: dict = {}

    def scores(self, ids: np.ndarray, ws: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines with all examples of ``blocks``; 0 elsewhere."""
        if len(blocks) == self.blocks:  # a term's postings of all blocks are neighbours
            low, n, own = self.starts[ids * self.blocks], self.starts[(ids + 1) * self.blocks] - self.starts[ids * self.blocks], ws
        else:
            cell = ids[:, None] * self.blocks + blocks[None, :]
            low, n, own = self.starts[cell].ravel(), (self.starts[cell + 1] - self.starts[cell]).ravel(), np.repeat(ws, len(blocks))
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        postings = np.arange(total) + np.repeat(low - (ends - n), n)
        return np.bincount(self.at[postings], np.repeat(own, n) * self.w[postings], len(self.ids))

    def nearest(self, ids, ws, k: int = NEAREST, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, place) of the k nearest, nearest first, ties by place; ``without`` leaves out one place."""
        if not len(ids) or not self.blocks:
            return []
        bounds = ws @ self.most[ids]
        order = np.argsort(-bounds, kind="stable")

        def best(blocks):
            score = np.round(self.scores(ids, ws, np.sort(blocks)), 12)
            if without >= 0:
                score[without] = 0
            least = np.partition(score, -k)[-k] if len(score) > k else 0.0
            hit = np.flatnonzero((score > 0) & (score >= least))
            hit = hit[np.argsort(-score[hit], kind="stable")[:k]]
            return list(zip((-score[hit]).tolist(), hit.tolist()))

        if 2 * bounds[order[-1]] > bounds[order[0]]:  # bounds as flat as these rule out next to nothing
            return [(-c, at) for c, at in best(order)]
        first = order[:2]
        found = best(first)
        least = -found[k - 1][0] if len(found) >= k else 0.0
        rest = order[len(first) :]
        rest = rest[(bounds[rest] > 0) & (bounds[rest] + 1e-6 >= least)]
        if len(rest) > self.blocks // 4:  # one pass over all blocks costs less than these one by one
            found = best(order)
        elif len(rest):
            found = sorted([*found, *best(rest)])[:k]
        return [(-c, at) for c, at in found]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Log odds of votes weighted by the cosine's fourth power, with a small vote for the prior."""
        votes = np.array([c**4 for c, _ in near])
        toxic = self.toxic[[at for _, at in near]] if near else np.zeros(0)
        extra = 0.25 * float(votes.max(initial=0.0)) + 1e-9
        p = (float(votes @ toxic) + self.prior * extra) / (float(votes.sum()) + extra)
        return float(np.log(p / (1 - p))) if 0 < p < 1 else 0.0

    def calibrate(self, examples: list, k: int = NEAREST) -> None:
        """Fits a logistic curve to votes on (doc_id, toxic, features, counts); an indexed example does not vote on itself."""
        place = {int(doc): at for at, doc in enumerate(self.ids)}
        some = [e for e in examples if len(e[2])]
        x = np.array([self.vote(self.nearest(*weigh(ids, counts, self.weight), k, place.get(doc, -1))) for doc, _, ids, counts in some])
        y = np.array([toxic for _, toxic, _, _ in some], np.float64)
        if not 0 < y.sum() < len(y):
            return
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # Platt's smoothed targets
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            gradient = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum()])
            step = np.linalg.solve(np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]]), gradient)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if a > 0:
            self.curve = a, b

    def score(self, ids, counts, k: int = NEAREST) -> tuple[float, list[int], list[int]]:
        """The score, the three nearest examples, and the three strongest terms."""
        if not self.n:
            return 0.5, [], []
        if not len(ids):
            return self.bare, [], []
        key = (np.asarray(ids, np.int32).tobytes(), np.asarray(counts, np.int32).tobytes())
        if key not in self.cache:
            if len(self.cache) > 2_000:
                self.cache.clear()
            own, w = weigh(ids, counts, self.weight)
            near = self.nearest(own, w, k)
            odds = min(30.0, max(-30.0, self.curve[0] * self.vote(near) + self.curve[1])) if near else math.log(self.bare / (1 - self.bare)) if 0 < self.bare < 1 else 0.0
            self.cache[key] = float(1 / (1 + np.exp(-odds))), [int(self.ids[at]) for _, at in near[:3]], own[np.argsort(-w, kind="stable")[:3]].tolist()
        return self.cache[key]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_indexed: int = MAX_INDEXED) -> tuple[BlockMaxIndex, list[str], DataFrame]:
    """The index, its vocabulary, and the vectors of all documents."""
    spark = docs.sparkSession
    chosen = materialize(sample(labels, max_examples), "toxicity-sample")
    totals = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    # At most max_examples ids are broadcast.
    of = F.broadcast(chosen.withColumnRenamed("doc_id", "of"))
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(of, F.col("doc_id") == F.col("of"))
    examples = labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    examples = materialize(examples.repartition(max(2, spark.sparkContext.defaultParallelism * 2), "doc_id"), "toxicity-examples")
    by_hash = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))  # of at most max_examples rows
    placed = materialize(examples.select("doc_id", "text", "toxic", by_hash.alias("place")), "toxicity-placed")
    indexed = placed.filter(F.col("place") <= max_indexed)
    telling = relevance(examples, totals.toxic, totals.n - totals.toxic)
    vocab = sorted(telling.keys() | set(indexed_words(indexed)))
    sparse = materialize(vectors(docs, vocab), "toxicity-vectors")
    n_docs = sparse.count()
    df = frequencies(sparse, len(vocab))
    weight = (np.log((1 + n_docs) / (1 + df)) + 1) * np.array([telling.get(f, 1.0) for f in vocab])
    few = placed.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(MAX_CALIBRATION).select("doc_id")
    wanted = vectors(placed.join(F.broadcast(few.withColumnRenamed("doc_id", "few")), F.col("doc_id") == F.col("few"), "left").filter((F.col("place") <= max_indexed) | F.col("few").isNotNull()), vocab)
    facts = {r.doc_id: (r.toxic, r.place) for r in placed.select("doc_id", "toxic", "place").collect()}  # max_examples at most
    calibrating = {r.doc_id for r in few.collect()}
    rows = []
    for batch in wanted.orderBy("doc_id").toArrow().to_batches():  # of max_examples documents at most, without a Python object a number
        cuts = batch.column("features").offsets.to_numpy() - batch.column("features").offsets[0].as_py()
        features, counts = (batch.column(c).flatten().to_numpy() for c in ("features", "counts"))
        rows += [(doc, facts[doc][0], features[x:y], counts[x:y]) for doc, x, y in zip(batch.column("doc_id").to_pylist(), cuts[:-1], cuts[1:])]
    built = BlockMaxIndex([r for r in rows if facts[r[0]][1] <= max_indexed], weight)
    built.calibrate([r for r in rows if r[0] in calibrating])
    return built, vocab, sparse


def score(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_indexed: int = MAX_INDEXED) -> DataFrame:
    """One row for each document: doc_id, score, evidence_ids (nearest examples), evidence (its strongest terms)."""
    with short_batches(docs.sparkSession):
        built, vocab, sparse = fit(docs, labels, max_examples, max_indexed)
    index = docs.sparkSession.sparkContext.broadcast((built, vocab))

    def run(batches):
        begins("toxicity")
        found, names = index.value
        for batch in pieces(batches):
            scores, near, why = [], [], []
            cuts = batch.column("features").offsets.to_numpy() - batch.column("features").offsets[0].as_py()
            features, counts = (batch.column(c).flatten().to_numpy() for c in ("features", "counts"))
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids, n = features[a:b], counts[a:b]
                s, e, strongest = found.score(ids, n)
                scores.append(s)
                near.append(e)
                why.append(",".join(names[i].rstrip("$") for i in strongest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(why, pa.string())], ["doc_id", "score", "evidence_ids", "evidence"])

    return sparse.mapInArrow(run, "doc_id bigint, score double, evidence_ids array<bigint>, evidence string")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold; equal ids are decided together, by their highest score."""
    bad = score(docs, labels, **options).filter(F.col("score") >= threshold).select("doc_id").distinct()
    return without_ids(docs, materialize(bad, "toxicity-rejected"))
