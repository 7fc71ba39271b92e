"""Secret scans: three fixed kinds, and a randomness test battery.

The base kinds are patterns.  The battery looks at every other long token,
infers its encoding, and asks whether it could be ordinary text: a token is
``random`` if chi-squared uniformity over the encoding's alphabet, the number
of runs and the serial correlation all agree with uniform draws, and if text
of that length would pass the same tests so rarely that the document's false
discoveries stay under ``fdr`` (Benjamini and Hochberg's step-up rule).

Null text counts as empty and has no spans.  Positions are code points, ends
exclusive.  Equal rows give equal results; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A longer key cannot start inside a run that a shorter one has used up, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
#: '=' belongs to a token only as padding at its end.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: What a token of no one encoding may hold: each reading takes the other's marks as ends.
READINGS = (re.compile(r"[A-Za-z0-9+/]{20,}=*"), re.compile(r"[A-Za-z0-9_-]{20,}=*"))

#: Encodings by alphabet, the narrowest first; a token belongs to the first that holds all its characters.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_INDEX = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]


def tail(z: float) -> float:
    """P(N > z) for a standard normal N."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_z(x: float, df: float) -> float:
    """Wilson and Hilferty's normal score of a chi-squared value."""
    return ((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    chars = set(token)
    return next(((name, index) for name, index in _INDEX if chars <= index.keys()), None)


def battery(token: str) -> dict | None:
    """Each test's p-value under uniform draws, and ``text_p``: how often text would pass."""
    body = token.rstrip("=")
    found = encoding(body)
    n = len(body)
    if not found or n < 20:
        return None
    name, index = found
    size = len(index)
    xs = [index[c] for c in body]
    expected = n / size
    chi = sum((c - expected) ** 2 for c in Counter(xs).values()) / expected + (size - len(set(xs))) * expected
    p_chi = tail(chi_z(chi, size - 1))
    median = (size - 1) / 2
    high = [x > median for x in xs]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        variance = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(variance))
    else:
        p_runs = 2.0**-n
    m = sum(xs) / n
    spread = sum((x - m) ** 2 for x in xs)
    serial = sum((x - m) * (y - m) for x, y in zip(xs, xs[1:])) / spread if spread else 1.0
    p_serial = 2 * tail(abs(serial + 1 / n) * math.sqrt(n))
    # Text draws a few letters far more often than others and hardly ever mixes
    # cases or digits: its chi-squared has about 0.8 of the alphabet's size a
    # character as noncentrality.  text_p is the chance that it falls this low.
    away = 0.8 * n if size <= 26 else 1.6 * n
    text_p = tail((size - 1 + away - chi) / math.sqrt(2 * (size - 1) + 4 * away))
    classes = sum(any(map(f, body)) for f in (str.islower, str.isupper, str.isdigit))
    changes = sum(kind(x) != kind(y) for x, y in zip(body, body[1:]))
    if classes > 1:  # in text, about one place in twelve changes between letters' cases and digits
        rate = 1 / 12
        text_p *= min(1.0, 2 * tail((changes - rate * n) / math.sqrt(n * rate * (1 - rate))))
    return {"encoding": name, "n": n, "chi": p_chi, "runs": p_runs, "serial": p_serial, "text_p": text_p, "classes": classes}


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2


def tokens(text: str):
    """(start, end) of the tokens, and of the pieces of those that no encoding holds."""
    for m in TOKEN.finditer(text):
        if encoding(m[0].rstrip("=")):
            yield m.span()
        else:
            yield from sorted({p.span() for reading in READINGS for p in reading.finditer(text, *m.span())})


def random_spans(text: str, alpha: float = 0.001, fdr: float = 1e-4) -> list[tuple[int, int, str]]:
    tested = []
    for start, end in tokens(text):
        got = battery(text[start:end])
        if got:
            passed = 3 * min(got["chi"], got["runs"], got["serial"]) >= alpha
            tested.append((got["text_p"] if passed and got["classes"] > 1 else 1.0, start, end, got["encoding"]))
    tested.sort()
    last = max((i for i, t in enumerate(tested, 1) if t[0] <= fdr * i / len(tested)), default=0)
    out: list[tuple[int, int, str]] = []
    for _, s, e, enc in tested[:last]:
        if all(e <= a or b <= s for a, b, _ in out):  # of two readings of one place, the less likely text
            out.append((s, e, enc))
    return out


def scan(text: str | None, alpha: float = 0.001, fdr: float = 1e-4) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, encoding) of a text, by start, then kind as listed."""
    if not text:
        return []
    spans = []
    if HINT.search(text):
        spans += [("assign", m.start(), m.end(), "") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end(), "") for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    spans += [("random", s, e, enc) for s, e, enc in random_spans(text, alpha, fdr)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string())])


def find_secrets(docs: DataFrame, alpha: float = 0.001, fdr: float = 1e-4) -> DataFrame:
    """One row for each document: doc_id and its spans, an array of structs."""

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "encoding"), s)) for s in scan(t, alpha, fdr)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind string, start bigint, end bigint, encoding string>>")
