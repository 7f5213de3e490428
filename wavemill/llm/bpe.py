"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

The encoding of a byte string is the only token sequence in which every neighbouring pair is
stable: no merge across the border of the two comes before the merges that build them.  So
longest matches whose borders are stable, with retreat where the rest cannot be covered, give it.
How far to the right a border can be influenced is bounded by the longest chain of ever earlier merges that overlap;
``Merges.lookahead`` is that bound in bytes for the given list.  Tokens that end further
back than that are final and are emitted, so memory stays constant on input of any length.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.columns import column

#: How byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a word cache; at twice as many the older half goes.
CACHE = 150_000
#: Input characters handed to the transducer at a time.
CHUNK = 1 << 16
#: Later than every merge.
NEVER = 1 << 60


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merge list, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or dropout is needed")
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in s) for s, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}  # by both ids in one integer
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        vocab = model["vocab"]
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 20 | y] = r
            if z not in self.parts:
                self.parts[z], self.made[z] = (x, y), r
                if max(self.made.get(x, -1), self.made.get(y, -1)) >= r:
                    raise ValueError("a merge comes before its parts")
        self.longest = max(map(len, self.id_of))
        self.sizes = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        #: The longest token that begins each beginning of a token, and the next shorter one of each token.
        self.heads: dict[bytes, int] = {}
        self.shorter = [-1] * len(self.sizes)
        for b, t in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            if len(b) > 1:
                self.shorter[t] = self._begin(b[:-1])
                for i in range(len(b) - 1, 1, -1):
                    if b[:i] in self.heads:
                        break
                    self.heads[b[:i]] = self._begin(b[:i])
            self.heads[b] = t
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._stable: dict[int, bool] = {}
        self.lookahead = self._lookahead()

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of t while it is built, each with the rank of the merge that takes it in."""
        known = (self._left, self._right)[side]
        out = known.get(t)
        if out is None:
            shift = 20 * side  # ready to be joined to a pair
            out = [(x, r) for x, r in self._edge(self.parts[t][side], side)] if t in self.parts else []
            if out:
                out[-1] = (out[-1][0], self.made[t])
            out.append((t << shift, NEVER))
            known[t] = out
        return out

    def _begin(self, head: bytes) -> int:
        """The longest token that is a beginning of ``head``."""
        return next((t for i in range(len(head), 0, -1) if (t := self.id_of.get(head[:i])) is not None), -1)

    def _lookahead(self) -> int:
        """Bytes to the right of a border that can decide whether it stays a border."""
        best: dict[int, int] = {}
        most = 0
        for pair, _ in sorted(self.rank.items(), key=lambda x: x[1]):
            a, b = pair >> 20, pair & 0xFFFFF
            reach = len(self.bytes_of[b]) + max(best.get(x >> 20, 0) for x, _ in self._edge(b, 1))
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def stable(self, a: int, b: int) -> bool:
        """Whether the border between neighbours a and b outlives all merges."""
        key = a << 20 | b
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 600_000:
                self._stable.clear()
            known = self._stable[key] = self._holds(a, b)
        return known

    def _holds(self, a: int, b: int) -> bool:
        get = self.rank.get
        if get(a << 20 | b) is not None:
            return False
        left, right = iter(self._right.get(a) or self._edge(a, 1)), iter(self._left.get(b) or self._edge(b, 0))
        (x, until_x), (y, until_y) = next(left), next(right)
        while True:
            r = get(x | y)
            # Of equal merges the leftmost goes first: inside a before the border, the border before b.
            if r is not None and r < until_x and r <= until_y:
                return False
            if until_x <= until_y:
                if until_x == NEVER:
                    return True
                x, until_x = next(left)
            else:
                y, until_y = next(right)

    def transduce(self, pieces: Iterator[bytes]) -> Iterator[int]:
        """Ids of one pre-token given in pieces; holds a few times the lookahead, however long it is."""
        data, margin = b"", self.lookahead + self.longest
        before: int | None = None  # the last token that was emitted
        for piece in pieces:
            data += piece
            while len(data) > 4 * margin:
                done, end = self._window(data[: 4 * margin], before), 0
                for t in done:
                    if end + len(self.bytes_of[t]) > 3 * margin:
                        break
                    yield t
                    before, end = t, end + len(self.bytes_of[t])
                data = data[end:]
        yield from self._window(data, before)

    def _window(self, data: bytes, before: int | None) -> list[int]:
        """Ids of ``data``, whose left neighbour is ``before``: stable longest matches, with retreat."""
        heads, shorter, sizes, known, stable = self.heads, self.shorter, self.sizes, self._stable, self.stable
        out: list[int] = []
        dead: set[int] = set()  # ends from which the rest cannot be covered
        n, at, t, fresh = len(data), 0, -1, True
        prev = -1 if before is None else before
        while at < n:
            if fresh:  # the longest token here
                end = at + 1
                head = data[at:end]
                while (found := heads.get(head)) is not None:
                    t = found
                    if end == n:
                        break
                    end += 1
                    head = data[at:end]
            while t >= 0:
                if not dead or at + sizes[t] not in dead:
                    fits = known.get(prev << 20 | t) if prev >= 0 else self._builds(t)
                    if fits is None:
                        fits = stable(prev, t)
                    if fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += sizes[t]
                prev, fresh = t, True
            else:
                dead.add(at)
                t = out.pop()
                at -= sizes[t]
                prev = out[-1] if out else -1 if before is None else before
                t, fresh = shorter[t], False
        return out

    def _builds(self, t: int) -> bool:
        """Whether merging the bytes of t gives t itself."""
        return t not in self.parts or not self.stable(*self.parts[t])

    def encode_word(self, word: bytes) -> list[int]:
        if (t := self.id_of.get(word)) is not None and self._builds(t):
            return [t]
        if len(word) <= self.lookahead:
            return self._window(word, None)
        return list(self.transduce(word[i : i + CHUNK] for i in range(0, len(word), CHUNK)))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


class Cache(dict):
    """Ids as little-endian 32-bit bytes by text, bounded; ``make`` gives what is missing."""

    def __init__(self, make, limit: int = CACHE):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Irregular(Exception):
    pass


class Encoder:
    """Encodes whole texts by a function from one pre-token to its ids."""

    def __init__(self, encode_word, special: dict[str, int]):
        self.encode_word = encode_word
        self.split = regex.compile(PATTERN)
        self.space = re.compile(r"\s")
        self.special = special
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # A blank before a word always starts a pre-token, so what lies between blanks is encoded apart.
        self.first = Cache(lambda s: self._chunk(s, ""), CACHE // 4)
        self.later = Cache(lambda s: self._chunk(s, " "))
        self.marks = {m: self._word(m) for m in ".,;:!?"}
        self.newline = self._word("\n")

    def _word(self, word: str) -> bytes:
        return np.array(self.encode_word(word), "<u4").tobytes()

    def _chunk(self, s: str, blank: str) -> bytes:
        if not s or self.space.search(s):
            raise _Irregular
        if s[-1] in self.marks and len(s) > 1 and s[-2].isalpha():  # a mark after a letter is a pre-token of its own
            return (self.later if blank else self.first)[s[:-1]] + self.marks[s[-1]]
        return self._word(blank + s) if s.isalpha() else b"".join([self._word(w) for w in self.split.findall(blank + s)])

    def _plain(self, text: str) -> bytes:
        try:
            out, later = [], self.later.__getitem__
            for n, line in enumerate(text.split("\n")):
                if n:
                    out.append(self.newline)
                chunks = line.split(" ")
                out.append(self.first[chunks[0]])
                out.extend(map(later, chunks[1:]))
            return b"".join(out)
        except _Irregular:  # runs of blanks and other white space
            return b"".join([self._word(m.group()) for m in self.split.finditer(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        return b"".join(
            np.array([self.special[x]], "<u4").tobytes() if n % 2 else self._plain(x) for n, x in enumerate(self.specials.split(text)) if x
        )


@functools.lru_cache(maxsize=4)
def transducer(path: str) -> Encoder:
    """The encoder whose words come from the streaming transducer."""
    merges = load(path)
    return Encoder(lambda w: merges.encode_word(w.encode()), merges.special)


class Decoder:
    """Ids to text, a run at a time: bytes of unfinished characters wait for their rest."""

    def __init__(self, merges: Merges):
        self.table = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode(ids: np.ndarray, merges: Merges, run: int = 1 << 16) -> str:
    """Text of ids; malformed UTF-8 becomes U+FFFD."""
    d = Decoder(merges)
    return "".join([d.feed(ids[i : i + run].tolist()) for i in range(0, len(ids), run)] + [d.finish()])


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` for every row, in one narrow pass.

    Null and empty texts have no ids and decode to the empty string.  A special token's string
    in a text is that token.  Repeated rows give repeated results and other columns are ignored.
    ``path`` must name the vocabulary on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, merges = transducer(path), load(path)
        for big in batches:
            for b in (big.slice(i, rows) for i in range(0, big.num_rows, rows)):
                codes = [coder.encode(x) for x in b.column(1).to_pylist()]
                flat = np.frombuffer(b"".join(codes), "<i4")
                ends = np.cumsum([0] + [len(c) // 4 for c in codes])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                texts = [decode(flat[s:e], merges) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([b.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
