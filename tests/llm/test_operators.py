"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm import bpe, fingerprints, line_dedup, lm_scoring, minhash, mixing, secrets, substring_dedup, toxicity
from docweave.llm.components import components
from docweave.llm.exact_dedup import DigestIndex, exact_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, rng, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus(seed=1, n=60):
    """Random texts; exact and near copies, repeated lines and passages, null, empty, blank and long ones."""
    rng = random.Random(seed)
    passage, line = words(70, rng, 5000), " ".join(words(9, rng))
    texts = []
    for i in range(n):
        ws = words(rng.choice([1, 3, 4, 5, 12, 60, 150]), rng, 3000)
        if i % 7 == 0:
            ws += passage
        t = " ".join(ws)
        if i % 3 == 0:
            t += "\n" + line + "\nÜber  Straße\t" + " ".join(words(20, rng))
        texts.append(t)
    near = texts[7].split(" ")
    for i in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"changed{i}"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3], texts[10].upper(), None, "", " \n\t ", None, " ".join(words(30_000, rng, 4000)), "one", "One", "a b c d", "A b c  d"]
    return [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("size", "score", "key", "id", "digest", "n", "component_id", "words", "part", "line", "ln", "_of", "of", "_gone", "gone", "row", "first", "ask"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark):
    d = empty(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for out in (
        lm_scoring.score(d), toxicity.score(d, labels), bpe.encode_decode(d, ranks, pattern), mixing.mix(d), mixing.mix_documents(d), fingerprints.compare_edited(d), exact_dedup(d),
        secrets.find_secrets(d), line_dedup.dedup_lines(d), substring_dedup.passages(d), minhash.near_components(d), minhash.near_dedup(d), toxicity.reject_toxic(d, labels),
    ):
        assert out.count() == 0


def grams(text):
    w = WORD.findall((text or "").translate(ASCII))
    return w


def test_lm_scoring(spark, docs, rows):
    got = {r.doc_id: r for r in lm_scoring.score(docs, block_bytes=20_000).collect()}
    texts = {r[0]: grams(r[1]) for r in rows}
    own = {d: [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)] for d, w in texts.items()}
    every = [sum((o[n] for o in own.values()), Counter()) for n in range(3)]
    total = sum(map(len, texts.values()))
    for d, w in texts.items():
        c = lambda g: every[len(g) - 1][g] - own[d][len(g) - 1][g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            for k, n in enumerate(range(min(3, i + 1), 0, -1)):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or c(g) > 0:
                    score += k * math.log(0.4) + math.log(c(g) / c(g[:-1]) if n > 1 else max(c(g), 0.5) / max(1, total - len(w)))
                    break
        assert got[d].n_words == len(w)
        assert (got[d].score is None) == (not w)
        if w:
            assert math.isclose(got[d].score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_toxicity(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        ws = words(80, rng, 4000)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                ws[rng.randrange(80)] = rng.choice(["vileness", "scorning", "hatefully", "vilest", "scornful"])
        docs.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    labels += [(0, 1, 1), (None, 1, 1), (5, 1, None)]
    d = spark.createDataFrame(docs, SCHEMA)
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, labelled).withColumn("held", toxicity.held_out()).collect()}
    held = [r for r in got.values() if r.held and r.doc_id < 900]
    assert len(got) == 902 and held
    assert sum((r.score >= 0.7) == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.5
    kept = {r.doc_id for r in toxicity.reject_toxic(d, labelled).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}
    none = toxicity.score(d, labelled.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_toxicity_is_the_vote_of_the_nearest(spark):
    """Every text with words has neighbours, clean ones too, and its score is that of a brute-force search."""
    import numpy as np

    rng = random.Random(13)
    texts = {}
    for i in range(240):
        ws = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(rng.choice([5, 40, 200]), rng, 900)]
        if i % 5 == 0:
            ws[0] = rng.choice(["vileness", "scorning"])
        texts[i] = " ".join(ws)
    d = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(5, "another text"), (999, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in texts], "doc_id bigint, toxic int")
    built, vocab, sparse = toxicity.fit(d, labels, max_indexed=60)
    rows = {(r.doc_id, tuple(r.features)): r for r in sparse.collect()}
    example = {}
    for (doc, _), r in sorted(rows.items(), key=lambda x: x[0][0]):
        ids, w = toxicity.weigh(r.features, r["counts"], built.weight)
        text = "another text" if doc == 5 and len(ids) <= 2 else texts.get(doc)
        if doc in built.ids and text == min(t for t in (texts[doc], "another text" if doc == 5 else texts[doc])):
            example[doc] = dict(zip(ids.tolist(), w))
    got = {}
    for r in toxicity.score(d, labels, max_indexed=60).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (doc, _), r in rows.items():
        ids, w = toxicity.weigh(r.features, r["counts"], built.weight)
        q = dict(zip(ids.tolist(), w))
        near = sorted(((sum(v * e.get(f, 0.0) for f, v in q.items()), o) for o, e in example.items()), reverse=True)[: toxicity.NEAREST]
        near = [(c, o) for c, o in near if c > 1e-12]
        if not near:
            assert doc == 999 or not r.features
            continue
        votes = np.array([c**4 for c, _ in near])
        extra = 0.25 * votes.max() + 1e-9
        p = (sum(v for v, (_, o) in zip(votes, near) if o % 5 == 0) + built.prior * extra) / (votes.sum() + extra)
        odds = built.curve[0] * np.log(p / (1 - p)) + built.curve[1]
        assert any(math.isclose(g.score, 1 / (1 + math.exp(-odds)), rel_tol=1e-6) for g in got[doc])
        assert any(g.evidence_ids for g in got[doc]) and (doc == 5 or len(got[doc]) == 1)


def test_block_max_index_is_exact():
    import numpy as np

    rng = random.Random(5)
    idf = np.array([rng.random() + 0.5 for _ in range(40)])
    examples = [(i, i % 2, sorted(rng.sample(range(40), rng.randint(1, 6))), None) for i in range(700)]
    examples = [(a, b, c, [rng.randint(1, 3) for _ in c]) for a, b, c, _ in examples]
    index = toxicity.BlockMaxIndex(examples, idf)
    for _ in range(30):
        ids = sorted(rng.sample(range(40), 4))
        q = dict(zip(*toxicity.weigh(ids, [1, 2, 1, 1], idf)))
        near = index.nearest(*toxicity.weigh(ids, [1, 2, 1, 1], idf), 15)
        every = sorted((sum(q.get(i, 0) * w for i, w in zip(*toxicity.weigh(c, n, idf))) for _, _, c, n in examples), reverse=True)[:15]
        assert np.allclose([c for c, _ in near], every, atol=1e-9)


def test_bpe(spark, docs, rows):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    extra = [(9000, "<|endoftext|> it's 12345 naïve \x1c\x85    日本語 🙂🙂\r\n\r\n  x", "", "", 0), (9001, "᠎​﻿\x00 ǅ ½ ٣", "", "", 0)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, SCHEMA).select("doc_id", "text"))
    texts = {r[0]: r[1] or "" for r in [*rows, *extra]}
    out = bpe.encode_decode(d, path, pattern).cache()
    for r in out.collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids) == (len(ids), ",".join(map(str, ids)))
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    for r in bpe.decode(out, path, pattern).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_bpe_memory_runs_over(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    c = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(3):
        n, ids, decoded = c.run(["alpha beta gammadelta", "zzqqxx epsilon"])
        assert decoded == [b"alpha beta gammadelta", b"zzqqxx epsilon"] and n == [len(i.split(",")) for i in ids]


def test_bpe_decodes_the_ids():
    """Wrong ids do not decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.Codec(path, public_tokenizers.PATTERN)
    c.run(["alpha"])
    c.known["alpha"] = ",".join(str(c.ranks[b]) for b in (b"o", b"m"))
    assert c.run(["alpha"])[1:] == ([c.known["alpha"]], [b"om"])


def test_bpe_long_pieces():
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("etaoinshrdlu日本語") for _ in range(n))
    texts = [letters(100_000), "=" * 100_000, " " * 30_000 + "x", *(letters(n) for n in (990, 999, 1000, 1001, 4000)), " ".join(letters(300) for _ in range(200))]
    n, ids, decoded = bpe.Codec(path, pattern).run(texts)
    want = [encoding.encode_ordinary(t) for t in texts]
    assert n == [len(w) for w in want] and ids == [",".join(map(str, w)) for w in want]
    assert [d.decode() for d in decoded] == texts


def water(sizes, weights, epochs=3):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / w > epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = epochs * sizes[i]
        total -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(names, water([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))])))
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-12) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    by_doc = Counter()
    for r in mixed.collect():
        by_doc[r.doc_id] += len(WORD.findall(r.text))
        assert next(t for i, t, *_ in rows if i == r.doc_id).startswith(r.text)
    assert by_doc == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_fingerprints(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs).withColumn("near", fingerprints.likeness(F.col("sample"), F.col("edited"))).collect()}
    order = sorted(rows)
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert (got[r[0]].n_chars, got[r[0]].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[r[0]].sample is None) == (not t.split())
    by_text = {}
    for r in rows:
        sample = got[r[0]].sample
        assert by_text.setdefault(r[1] or "", sample) == sample
    twice = spark.createDataFrame([rows[0], rows[0], (None, "x y", "", "", 0)], SCHEMA)
    assert fingerprints.compare_edited(twice).count() == 3


def test_collision_rate_is_generalised_jaccard(spark):
    pairs = [("a", "a b"), ("x x x y", "x y y y y"), ("a " * 20 + "b c d", "a " * 10 + "e e e f f")]
    d = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id bigint, text string")
    s = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(d, 2048).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = Counter(a.split()), Counter(b.split())
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs(sum(p == q for p, q in zip(s[2 * i], s[2 * i + 1])) / 2048 - true) < 0.05


def test_exact_dedup(spark, docs, rows, tmp_path):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        for r in exact_dedup(docs, keep).collect():
            t = next(x[1] or "" for x in rows if x[0] == r.doc_id)
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (pick(groups[t]), len(groups[t]), r.doc_id == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    same = exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string"), "largest").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in same) == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, True): 1}
    index = DigestIndex(spark, str(tmp_path / "index"))
    one = spark.createDataFrame([(5, b"x"), (4, b"x"), (9, b"y")], "doc_id bigint, digest binary")
    index.flush(one)
    index.flush(one.withColumn("doc_id", F.col("doc_id") - 4))
    assert {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()} == {b"x": (0, 4), b"y": (5, 2)}
    assert index.probe(F.lit(b"y")).count() == 2


def test_secrets(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        'Password = "hunter22" ü secret=token: abcdefgh apiKey:x', "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 12, "f" * 23 + "g" + "0" * 24, f"see {key} there", "antidisestablishmentarianism" * 2, None, "", "ſecret=abcdefg",
    ]
    got = [[(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got[0] == [("assign", 0, 20)]
    assert got[1] == [("access", 20, 40)] and got[2] == [("hex", 24, 48)]
    assert got[3] == [("random", 4, 44)] and got[4:] == [[], [], [], []]


def test_secrets_inside_assignments_and_paths():
    """Keys after an inner '=', or beside marks of another encoding, are tested on their own."""
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    for before, after in (("session=", ""), ("KEY=", "=="), ("?sig=", "&x=1"), ("some/path_", ""), ("a-b/", "_c+d"), ("", "=value")):
        spans = [(s, e) for kind, s, e, _ in secrets.scan(f"see {before}{key}{after} there") if kind == "random"]
        assert len(spans) == 1 and spans[0][0] <= 4 + len(before) and spans[0][1] >= 4 + len(before) + 40, (before, after, spans)


def line_sets(text):
    return [frozenset(w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w) for line in text.split("\n")]


def test_line_dedup(spark, docs, rows):
    rng = random.Random(9)
    base = words(20, rng, 10_000)
    near = [(5000 + i, "\n".join([" ".join(base[:10] + [f"v{i}"] + base[11:]), f"own {i} line of words here"]), "", "", 0) for i in range(300)]
    every = [*rows, *near]
    df = spark.createDataFrame(every, SCHEMA).withColumn("words", F.lit(1)).withColumn("ln", F.lit(2))
    seen, want = [], {}
    for d, t, *_ in sorted(every):
        if t is None:
            want[d] = None
            continue
        kept = []
        for s, line in zip(line_sets(t), t.split("\n")):
            if not s or not any(len(s & o) * 180 >= 80 * (len(s) + len(o)) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[d] = "\n".join(kept)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_line_dedup_tables(spark, docs, monkeypatch):
    """The tables of all lines and of the first members' words are dropped before the join, which takes most of the disk."""
    from pathlib import Path

    from docweave.llm.common import scratch
    from docweave.sources.scratch import shared_dir

    folder, left, join = scratch("lines"), [], line_dedup.candidates
    at = Path(shared_dir(spark).removeprefix("file://"), "docweave", folder)
    monkeypatch.setattr(line_dedup, "candidates", lambda *a: left.extend(p.name for p in at.iterdir()) or join(*a))
    assert line_dedup.similar_lines(docs, folder=folder).count()
    assert any(x.startswith("classes") for x in left) and not {"lines", "heads"} & {x.split("-")[0] for x in left if not x.startswith("head-")}


def test_line_dedup_bits(spark):
    """Lines differ in as many words as their bits at least, wherever the mark between rarer and other words falls."""
    rng = random.Random(10)
    lines = [" ".join(words(rng.choice([1, 5, 30, 90]), rng, 200)) for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    table = line_dedup.rarity(df.withColumnRenamed("line", "text"))
    assert 0 < line_dedup.middle(table) >> 51 < 128 and line_dedup.middle([0] * line_dedup.BUCKETS) == 0
    ranks = df.select("line", line_dedup.ranked(F.col("line"), table).alias("w"))
    rows = ranks.select("w", line_dedup.parity(F.filter("w", lambda x: x < line_dedup.middle(table))).alias("bits"), line_dedup.parity(F.filter("w", lambda x: x >= line_dedup.middle(table))).alias("more")).collect()
    for a in rows:
        for b in rows:
            differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in ((a.bits, b.bits), (a.more, b.more)))
            assert differ <= len(set(a.w) ^ set(b.w))


def test_substring_dedup(spark, docs, rows):
    got = substring_dedup.passages(docs).collect()
    texts = {r[0]: grams(r[1]) for r in rows}
    first, later = {}, set()
    for d in sorted(texts):
        for i in range(len(texts[d]) - 50):
            if first.setdefault(tuple(texts[d][i : i + 51]), d) != d:
                later.add(d)
    assert later and later <= {r.doc_id for r in got}
    for r in got:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.other_id][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.8 and len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_substring_partners_in_parts(spark):
    """Halves of a passage in earlier documents, too short to be passages, do not hide its whole."""
    rng = random.Random(7)
    texts, want = [], set()
    for n in (60, 80, 90):
        for _ in range(15):
            passage = words(n, rng, 20_000)
            for part in (passage[: n // 2], passage[n // 2 :], passage, passage):
                texts.append(" ".join(words(40, rng, 20_000) + part + words(40, rng, 20_000)))
            want.add(len(texts) - 1)
    got = {(r.doc_id, r.other_id) for r in substring_dedup.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {(d, d - 1) for d in want} <= got


def test_substring_links_between_pieces(spark):
    """Pieces of a passage before and after its first document hide neither a changed copy nor any pair of copies."""
    rng = random.Random(9)
    texts, want = [], set()
    add = lambda p: texts.append(" ".join(words(40, rng, 20_000) + p + words(40, rng, 20_000))) or len(texts) - 1
    for _ in range(15):
        passage = words(66, rng, 20_000)
        pieces = [passage[i : i + 22] for i in (0, 22, 44)]
        changed = [f"other{i}" if i in (21, 22, 43, 44) else w for i, w in enumerate(passage)]
        holders = []
        for p in (*pieces, passage, *pieces, changed, *pieces, passage):
            at = add(p)
            if len(p) == 66:
                holders.append(at)
        want |= {(b, a) for a in holders for b in holders if a < b}
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.doc_id, r.other_id) for r in substring_dedup.passages(data).collect()} == want
    assert {(r.doc_id, r.other_id) for r in substring_dedup.passages(data, most=None).collect()} == want


def test_substring_fuzzy_recall(spark):
    """Passages with words exchanged at random, at identities down to 0.8."""
    rng = random.Random(8)
    texts, want = [], set()
    for n in (60, 100, 200):
        for percent in (5, 10, 15, 20):
            for _ in range(10):
                passage = words(n, rng, 20_000)
                copy = list(passage)
                for i in rng.sample(range(n), n * percent // 100):
                    copy[i] = f"other{i}"
                texts += [" ".join(words(40, rng, 20_000) + p + words(40, rng, 20_000)) for p in (passage, copy)]
                want.add(len(texts) - 1)
    got = {r.doc_id for r in substring_dedup.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_chains_use_a_nearer_match():
    """Two runs far apart are two chains, and the second is whole."""
    first, second = [(i, i) for i in range(0, 120, 6)], [(270 + i, 270 + i) for i in range(0, 120, 6)]
    assert sorted(map(len, substring_dedup.chains(first + second)), reverse=True)[:2] == [20, 20]


def test_substring_words(spark):
    """Words in runs of 51 words or more that an earlier document has are covered, whatever stands elsewhere before."""
    rng = random.Random(21)
    pool = [words(60, rng, 50_000) for _ in range(12)]
    texts = ["The " * 90 + "end", "The " * 400]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.choice([0, 0, 10, 20])
            parts += words(rng.randint(0, 30), rng, 50_000) + p[a : a + rng.choice([24, 30, 55, 60])]
        texts.append(" ".join(parts))
    texts += [" ".join(pool[0][:24]), " ".join(words(150, rng, 50_000))]
    spread = words(150, rng, 50_000)
    texts += [" ".join(pool[1] + spread + pool[2]), " ".join(pool[1] + words(150, rng, 50_000) + pool[2])]
    found = substring_dedup.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    covered: dict[int, set] = {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    seen, wanted, missed = {}, 0, 0
    for d, t in enumerate(texts):
        w = [x.lower() for x in t.split()]
        runs = {tuple(w[i : i + 51]): i for i in range(len(w) - 50)}
        at = {x for i in range(len(w) - 50) if tuple(w[i : i + 51]) in seen for x in range(i, i + 51)}
        seen.update(dict.fromkeys(runs, d))
        wanted += len(at)
        missed += len(at - covered.get(d, set()))
    assert wanted > 1500 and missed <= 0.01 * wanted


def test_lm_counts_beyond_32_bits():
    import numpy as np

    counts = np.array([1, 1 << 33, 7], np.uint64)
    assert lm_scoring.unpack_counts(lm_scoring.pack_counts(counts)).tolist() == counts.tolist()


def test_chains_follow_the_order():
    matches = [(0, 100), (10, 110), (20, 50), (30, 130), (40, 141)]
    best = substring_dedup.chains(matches)[0]
    assert best == [(0, 100), (10, 110), (30, 130), (40, 141)]


def near_links(texts, percent):
    sets = {}
    for d, t in texts.items():
        w = grams(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, docs, rows, percent):
    rng = random.Random(4)
    chain = words(200, rng, 10_000)
    more = []
    for i in range(25):  # each is near the one before, the last far from the first
        chain = list(chain)
        chain[rng.randrange(200)] = f"step{i}"
        more.append((7000 + i, " ".join(chain), "", "", 0))
    every = [*rows, *more]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(spark.createDataFrame(every, SCHEMA), percent).collect()}
    want = near_links({r[0]: r[1] for r in every}, percent)
    assert got == want
    kept = {r.doc_id for r in minhash.near_dedup(spark.createDataFrame(every, SCHEMA), percent).collect()}
    assert kept == {d for d, (_, c) in want.items() if d == c}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (7, 7)] + [(200, 201 + i) for i in range(50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, **{i: 200 for i in range(200, 251)}}
