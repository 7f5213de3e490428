"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

Patterns give the base spans.  Other long tokens are scored under a model of random strings and one of
ordinary identifiers, both of first order over printable ASCII with add-one smoothing and
trained from labelled samples.  Random: found secrets and generated strings.  Ordinary: the corpus's
other tokens that read like words, names or numbers, some of them joined to identifiers, and generated
numbers; secrets that the patterns miss so do not teach the model that they are ordinary.  A token whose
ratio is high enough becomes a span of kind ``random``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.columns import column
from wavemill.llm.spans import Span, apart

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Alphabets of the generated random strings.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
SIZE = 96
#: Characters of a token for each change between lower case, upper case and digits that an ordinary one has at least.
CALM = 6


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points.  A run of hex digits of 24 or more holds no shorter match, so the length is in the pattern."""
    lower = text.encode().lower()
    out: list[Span] = []
    if any(w in lower for w in WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


def values(text: str, spans: list[Span]) -> list[str]:
    """The secrets within base spans."""
    return [ASSIGN.match(text, s, e)[2] if k == 0 else text[s:e] for k, s, e in spans]


def ordinary(token: str) -> bool:
    """The label of a token outside all base spans: whether it changes between kinds of characters no more often than names and numbers do.

    A capital before small letters, and any sign, is no change.  Long random strings over two kinds of
    characters or more change several times as often.
    """
    changes, before = 0, ""
    for c in token:
        kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else ""
        changes += bool(before and kind and kind != before and not (before == "u" and kind == "l"))
        before = kind
    return changes * CALM <= len(token)


class Ratio:
    """Log-likelihood ratio of character pairs: random strings over ordinary identifiers."""

    def __init__(self, counts: np.ndarray):
        """``counts[label, before, after]`` with code 0 for the start and 1 more than c - 32 for character c."""
        logs = np.log(counts + 1.0) - np.log(counts.sum(axis=2, keepdims=True) + counts.shape[2])
        self.table = (logs[1] - logs[0]).tolist()

    def score(self, s: str) -> float:
        total, before = 0.0, 0
        for c in s.encode():
            total += self.table[before][c - 31]
            before = c - 31
        return total


def count_pairs(tokens: list[str]) -> np.ndarray:
    """Counts by (before, after); a token's first character comes after the start."""
    codes = np.frombuffer("".join(f"\x1f{t}" for t in tokens).encode(), np.uint8).astype(np.int64) - 31
    after = np.flatnonzero(codes)
    return np.bincount(codes[after - 1] * SIZE + codes[after], minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def generated(n: int, seed: int) -> list[str]:
    """Labelled random strings, ``n`` for each alphabet, of 16 to 64 characters."""
    rng = random.Random(seed)
    return ["".join(rng.choices(a, k=rng.randint(16, 64))) for a in ALPHABETS for _ in range(n)]


def numbers(n: int, seed: int) -> list[str]:
    """Labelled ordinary numbers: digits in one to four groups."""
    rng = random.Random(seed)
    return [rng.choice("-_/").join("".join(rng.choices("0123456789", k=rng.randint(2, 9))) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def identifiers(tokens: list[str]) -> list[str]:
    """Every eighth ordinary token joined to the next, as names in code and paths are."""
    return ["-_/"[i % 3].join(pair) for i, pair in enumerate(zip(tokens[::8], tokens[1::8], strict=False))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, strings: int = 1000, seed: int = 1) -> Ratio:
    """Models from whole texts of the ``sample`` documents of the smallest id hashes, and ``strings`` generated for each alphabet and as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE, SIZE), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                total[1] += count_pairs(values(text, spans))
                others = apart(((0, *m.span()) for m in TOKEN.finditer(text)), spans)
                plain = [t for _, s, e in others if ordinary(t := text[s:e])]
                total[0] += count_pairs(plain + identifiers(plain))
        label, before, after = np.nonzero(total)
        cols = [pa.array(x.astype(np.int32)) for x in (label, before, after)] + [pa.array(total[label, before, after])]
        yield pa.record_batch(cols, names=["label", "a", "b", "n"])

    order = F.xxhash64(F.col(id_col).cast("string"))
    limit = docs.where(F.col(text_col).isNotNull()).select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    counts = np.zeros((2, SIZE, SIZE), np.int64)
    if limit is not None:
        rows = docs.where(F.col(text_col).isNotNull() & (order <= limit)).select(F.col(text_col).cast("string").alias("text"))
        found = rows.mapInArrow(run, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).toArrow()
        label, a, b, n = (found.column(c).to_numpy() for c in ("label", "a", "b", "n"))
        counts[label, a, b] = n
    counts[0] += count_pairs(numbers(strings, seed))
    counts[1] += count_pairs(generated(strings, seed))
    return Ratio(counts)


def added_spans(text: str, ratio: Ratio, base: list[Span], least: float, per_char: float) -> list[Span]:
    """Tokens of 16 characters or more that look random and touch no base span."""
    out = []
    for _, s, e in apart(((3, *m.span()) for m in CANDIDATE.finditer(text)), base):
        score = ratio.score(text[s:e])
        if score >= least and score >= per_char * (e - s):
            out.append((3, s, e))
    return out


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 8.0, per_char: float = 0.35, sample: int = 2000, ratio: Ratio | None = None
) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, base>>)`` of every row, ordered by start, then kind.

    Offsets are code points, end exclusive.  Null and empty texts have no spans.  ``least`` (nats) and
    ``per_char`` are what a token's ratio must reach.  Repeated rows give repeated results; other columns
    are ignored, whatever their names; an empty table gives no rows.  The time for a text grows with its
    length, however many spans it has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio or train(docs, id_col, text_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ends, flat = [0], []
            for text in b.column(1).to_pylist():
                if text:
                    base = base_spans(text)
                    flat += sorted(base + added_spans(text, model, base, least, per_char), key=lambda x: (x[1], x[0], x[2]))
                ends.append(len(flat))
            kind, start, end = (list(c) for c in zip(*flat, strict=True)) if flat else ([], [], [])
            spans = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([k < 3 for k in kind], pa.bool_())], names=["kind", "start", "end", "base"]
            )
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["doc_id", "spans"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _counter(kind: str):
    return lambda n, x: n + F.when(x["kind"] == kind, 1).otherwise(0)


def summary(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the text of all spans."""
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.aggregate(base, F.lit(0).cast("long"), _counter(k)).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
