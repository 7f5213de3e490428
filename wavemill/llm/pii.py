"""Personal data: patterns, and a semi-Markov conditional random field over token segments.

Patterns give the base spans.  The field labels a window of tokens around every place that might hold
an entity: a segment of up to ``LONGEST`` tokens is an email, ip, card or phone, or a single token
is outside.  Features look at a candidate segment whole (digit count, checksum, groups, signs, what
stands before it); dynamic programming over segments of bounded length chooses borders
and types jointly, and the forward sums over the same lattice give the likelihood it is
trained with.  Training windows come from labelled samples: base spans, also in disguises that
the patterns miss, and number groups that are no personal data.

A text of any length takes time in proportion: patterns never step back over what they have read, and
stretches around triggers, however many tokens they have, are searched with a few tokens in memory.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.columns import column
from wavemill.llm.spans import Span, apart

KINDS = ("email", "ip", "card", "phone")
LONGEST = 8
#: Tokens around a trigger that a window takes in.
MARGIN = 6
#: Characters that a window reaches beyond a trigger at most.
REACH = 512
# The patterns of the base spans.  The parts of each exclude each other, so possessive repeats
# match the same; a digit run is read once, for a match that starts within it starts at its first digit.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"@|(?:[0-9][^A-Za-z0-9\n]{0,3}){7}|[0-9]{1,3}(?:[^A-Za-z0-9\n]{1,3}[0-9]{1,3}){3}|(?<=[\x20\[(])(?:dot|DOT)(?=[\x20\])])")
TOKEN = re.compile(r"[^\s,;]+")
AT = re.compile(r"@|[\[(]at[\])]|\bat\b", re.IGNORECASE)
DOT = re.compile(r"[\[(]dot[\])]|\bdot\b", re.IGNORECASE)
PARTS = re.compile(r"[0-9]+")
HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "account", "iban"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(PARTS.findall(s))


def octet(part: str) -> bool:
    """Whether a digit run of any length is a number up to 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points of the base patterns, each leftmost without overlaps."""
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:  # what stands left of an @ fixes where a match can start
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((0, *m.span()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


@functools.lru_cache(maxsize=1 << 15)
def plausible(s: str) -> bool:
    """Whether a segment may be an entity at all; others are outside without being scored."""
    if len(s) > 120 or s[0].isspace():
        return False
    if "@" in s or (DOT.search(s) and AT.search(s)):
        return True
    if sum(c.isalpha() for c in s) > 8:
        return False
    parts = PARTS.findall(s)
    return 7 <= sum(map(len, parts)) <= 24 or (len(parts) == 4 and max(map(len, parts)) <= 3)


def hints_of(before: str) -> tuple[str, ...]:
    """The kinds that the token before a segment hints at."""
    word = before[-40:].lower()
    return tuple(k for k, hints in HINTS.items() if any(h in word for h in hints))


@functools.lru_cache(maxsize=1 << 15)
def features(s: str, hints: tuple[str, ...]) -> tuple[str, ...]:
    """Names of the whole-span features of a segment after a token with the given hints."""
    d, letters = digits_of(s), sum(c.isalpha() for c in s)
    parts = [p for p in re.split(r"[^0-9]+", s) if p]
    out = [
        f"digits={min(len(d), 20)}", f"groups={min(len(parts), 7)}", f"tokens={len(s.split())}", f"plus={s[0] == '+'}", f"paren={'(' in s}", f"dots={min(s.count('.'), 4)}",
        f"dashes={min(s.count('-'), 4)}", f"at={bool(AT.search(s))}", f"dotword={bool(DOT.search(s))}", f"letters={min(letters, 3)}", f"lead={s[0].isalnum() or s[0] in '+('}",
        f"tail={s[-1].isalnum() or s[-1] == ')'}", f"card={12 <= len(d) <= 19 and luhn(d)}", f"sizes={'-'.join(str(min(len(p), 9)) for p in parts[:6])}",
    ]
    quad = len(parts) == 4 and all(map(octet, parts)) and not letters
    out.append(f"quad={quad}")
    if AT.search(s) and letters:
        shape = re.sub(r"[A-Za-z0-9_%+-]+", "a", AT.sub("@", DOT.sub(".", s)).replace(" ", ""))
        out.append(f"shape={shape[:12]}")
    out += [f"hint={k}" for k in hints]
    return tuple(out)


class Lattice:
    """Scored candidates of one window: tokens, and segments (first, last + 1, features)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]] | None = None):
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)] if tokens is None else tokens
        self.segments: list[tuple[int, int, tuple[str, ...]]] = []
        for i, (s, _) in enumerate(self.tokens):
            hints = None
            for j in range(i + 1, min(i + LONGEST, len(self.tokens)) + 1):
                end = self.tokens[j - 1][1]
                if end - s > 200:  # too long for an entity, and so are longer ones
                    break
                piece = text[s:end].rstrip(".:!?")
                if piece and plausible(piece):
                    if hints is None:
                        hints = hints_of(text[slice(*self.tokens[i - 1])][-40:]) if i else ()
                    self.segments.append((i, j, features(piece, hints)))

    def place(self, segment: tuple[int, int, tuple[str, ...]]) -> tuple[int, int]:
        s, e = self.tokens[segment[0]][0], self.tokens[segment[1] - 1][1]
        return s, s + len(self.text[s:e].rstrip(".:!?"))


class Field:
    """Weights by kind and feature; outside scores 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.top: dict[tuple[str, ...], tuple[float, int]] = {}

    def score(self, names: tuple[str, ...]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights.get(f, zero) for f in names), zero)

    def scores(self, x: Lattice) -> np.ndarray:
        return np.array([self.score(fs) for _, _, fs in x.segments]).reshape(-1, len(KINDS))

    def likeliest(self, names: tuple[str, ...]) -> tuple[float, int]:
        """The best kind of a segment and its score, a bounded number kept; the weights are final by then."""
        if names not in self.top:
            if len(self.top) >= 1 << 15:
                self.top.clear()
            score = self.score(names)
            self.top[names] = float(score.max()), int(score.argmax())
        return self.top[names]

    def best(self, x: Lattice) -> list[Span]:
        """The best labelling: segments of bounded length, any number of tokens outside."""
        if not x.segments:
            return []
        n = len(x.tokens)
        value, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        ending: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(x.segments):
            ending.setdefault(j, []).append(k)
        for at in range(1, n + 1):
            value[at] = value[at - 1]
            for k in ending.get(at, ()):
                i, _, names = x.segments[k]
                score, y = self.likeliest(names)
                if value[i] + score > value[at]:
                    value[at], back[at] = value[i] + score, (k, y)
        out, at = [], n
        while at:
            if back[at] is None:
                at -= 1
            else:
                k, y = back[at]
                out.append((y, *x.place(x.segments[k])))
                at = x.segments[k][0]
        return out[::-1]

    def expected(self, x: Lattice) -> tuple[np.ndarray, float]:
        """Probability of each segment and kind, and the log of the sum over all labellings."""
        score, n = self.scores(x), len(x.tokens)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        whole = np.logaddexp.reduce(score, axis=1) if len(score) else []
        for at in range(1, n + 1):
            alpha[at] = np.logaddexp.reduce([alpha[at - 1], *(alpha[i] + w for (i, j, _), w in zip(x.segments, whole, strict=True) if j == at)])
        for at in range(n - 1, -1, -1):
            beta[at] = np.logaddexp.reduce([beta[at + 1], *(beta[j] + w for (i, j, _), w in zip(x.segments, whole, strict=True) if i == at)])
        p = np.array([np.exp(alpha[i] + beta[j] - alpha[n] + s) for (i, j, _), s in zip(x.segments, score, strict=True)])
        return p.reshape(-1, len(KINDS)), float(alpha[n])


def fit(samples: list[tuple[str, list[Span]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum conditional likelihood by stochastic gradient over labelled windows."""
    data = []
    for text, gold in samples:
        x = Lattice(text)
        y = {(s, e): k for k, s, e in gold}
        labels = [y.get(x.place(g)) for g in x.segments]
        if sum(k is not None for k in labels) >= len(gold):
            data.append((x, labels))
    field, rng = Field({}), random.Random(seed)
    for r in range(rounds):
        rng.shuffle(data)
        step = rate / (1 + r)
        for x, labels in data:
            if not x.segments:
                continue
            p, _ = field.expected(x)
            done: set[tuple[int, int]] = set()
            for k, (seg, label) in enumerate(zip(x.segments, labels, strict=True)):
                gradient = -p[k]
                if label is not None and x.place(seg) not in done:
                    done.add(x.place(seg))
                    gradient = gradient.copy()
                    gradient[label] += 1
                if np.abs(gradient).max() > 1e-3:
                    for f in seg[2]:
                        w = field.weights.get(f)
                        field.weights[f] = step * gradient if w is None else w * (1 - step * decay) + step * gradient
    return field


def disguised(kind: int, s: str, rng: random.Random) -> str:
    """A labelled entity in a form that its pattern does not match."""
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        name, _, host = s.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return s.replace(".", rng.choice(["[.]", " . "]))
    if kind == 2:
        d, sep = digits_of(s), rng.choice([".", "/", " - "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    d = digits_of(s)
    return rng.choice([f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"00{d}"])


def other_numbers(rng: random.Random) -> str:
    """Digits that are no personal data: dates, amounts, versions, codes."""
    r = lambda n: "".join(rng.choices("0123456789", k=n))
    return rng.choice([f"20{r(2)}-{r(2)}-{r(2)}", f"{r(3)}.{r(3)}.{r(3)},{r(2)}", f"{r(2)}:{r(2)}:{r(2)}.{r(3)}", r(rng.randint(7, 11)), r(rng.randint(20, 24)), f"{r(1)}.{r(2)}.{r(4)}-{r(2)}", f"{r(4)}/{r(5)}", unlucky(rng)])


def unlucky(rng: random.Random) -> str:
    while luhn(d := "".join(rng.choices("0123456789", k=16))):
        pass
    return d


def samples_of(text: str, rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Labelled windows of a text: each base span as it is, disguised, and replaced by another number."""
    out = []
    for kind, s, e in base_spans(text):
        words = [m.span() for m in TOKEN.finditer(text[max(0, s - 60) : s])][-3:], [m.span() for m in TOKEN.finditer(text[e : e + 60])][:3]
        left = text[max(0, s - 60) :][words[0][0][0] : s - max(0, s - 60)] if words[0] else ""
        right = text[e : e + (words[1][-1][1] if words[1] else 0)]
        if base_spans(left) or base_spans(right) or DIGIT.search(left + right) or "@" in left + right or (left and not left[-1].isspace()) or (right and right[0].isalnum()):
            continue
        entity = text[s:e]
        for form, gold in ((entity, True), (disguised(kind, entity, rng), True), (other_numbers(rng), False)):
            out.append((left + form + right, [(kind, len(left), len(left) + len(form))] if gold else []))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, windows: int = 1500) -> Field:
    """A field from windows of the ``sample`` documents of the smallest id hashes, ``windows`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (window, gold) in enumerate(samples_of(text, random.Random(h))):
                    k, s, e = gold[0] if gold else (-1, 0, 0)
                    out.append((h, n, window, k, s, e))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.record_batch(cols, names=["h", "n", "window", "k", "s", "e"])

    order = F.xxhash64(F.col(id_col).cast("string"))
    rows = docs.where(F.col(text_col).isNotNull()).select(order.alias("h"), F.col(text_col).cast("string").alias("text"))
    limit = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return Field({})
    found = rows.where(F.col("h") <= limit).mapInArrow(run, "h long, n int, window string, k int, s int, e int")
    rows = found.dropDuplicates(["h", "n"]).orderBy("h", "n").limit(windows).collect()
    return fit([(r["window"], [(r["k"], r["s"], r["e"])] if r["k"] >= 0 else []) for r in rows])


def windows_of(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, cut at white space up to ``REACH`` away and merged where they overlap."""
    low = high = -1
    for m in TRIGGER.finditer(text):
        if m.end() <= high:
            continue
        s, e = m.span()
        first, last = max(0, s - REACH), min(len(text), e + REACH)
        for _ in range(MARGIN):
            s = max(text.rfind(" ", first, max(first, s - 1)), text.rfind("\n", first, max(first, s - 1)), first - 1) + 1
        for _ in range(MARGIN):
            e = min([x for x in (text.find(" ", e + 1, last), text.find("\n", e + 1, last)) if x >= 0], default=last)
        if s <= high:
            high = max(e, high)
        else:
            if high >= 0:
                yield low, high
            low, high = s, e
    if high >= 0:
        yield low, high


def best_spans(field: Field, text: str, low: int, high: int) -> Iterator[Span]:
    """The best labelling of a stretch of any number of tokens, as ``Field.best`` gives it for all of them at once.

    Tokens are read ``LONGEST`` ahead.  Of the search only the value here and those of segments that are still open are
    kept; where none is open all choices before are settled and given out.
    """
    ahead: deque[tuple[int, int]] = deque()
    tokens = TOKEN.finditer(text, low, high)
    value, at, settled, before = 0.0, 0, 0, None
    waiting: dict[int, list[tuple]] = {}
    chosen: dict[int, tuple[int, Span]] = {}
    while True:
        ahead.extend(m.span() for m in itertools.islice(tokens, LONGEST - len(ahead)))
        if not ahead:
            return
        s, hints = ahead[0][0], None
        for n, (_, end) in enumerate(ahead):
            if end - s > 200:  # too long for an entity, and so are longer ones
                break
            piece = text[s:end].rstrip(".:!?")
            if piece and plausible(piece):
                if hints is None:
                    hints = hints_of(text[slice(*before)][-40:]) if before else ()
                score, kind = field.likeliest(features(piece, hints))
                waiting.setdefault(at + n + 1, []).append((value + score, at, (kind, s, s + len(piece))))
        before = ahead.popleft()
        at += 1
        for total, start, span in waiting.pop(at, ()):
            if total > value:
                value, chosen[at] = total, (start, span)
        if not waiting:
            out, back = [], at
            while back > settled:
                if back in chosen:
                    back, span = chosen[back]
                    out.append(span)
                else:
                    back -= 1
            yield from reversed(out)
            chosen.clear()
            settled = at


def added_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Entities of the best labelling that touch no base span."""
    found = (span for low, high in windows_of(text) for span in best_spans(field, text, low, high))
    return list(apart(found, base))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, field: Field | None = None) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, base>>)`` of every row, ordered by start, then kind.

    Offsets are code points, end exclusive.  Null and empty texts have no spans.  Repeated rows give
    repeated results; other columns are ignored, whatever their names; an empty table gives no rows.
    Where no sample holds an entity nothing is added.  The time for a text grows with its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, id_col, text_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ends, flat = [0], []
            for text in b.column(1).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [(s, k, e, True) for k, s, e in base] + [(s, k, e, False) for k, s, e in added_spans(text, model, base)]
                    flat += sorted(spans)
                ends.append(len(flat))
            start, kind, end, own = (list(c) for c in zip(*flat, strict=True)) if flat else ([], [], [], [])
            spans = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(own, pa.bool_())], names=["kind", "start", "end", "base"]
            )
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["doc_id", "spans"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")
