"""Removal of byte strings that occur again, by suffix arrays of shards.

A string of ``length`` bytes has an anchor: the place in it where a hash of 32 bytes is smallest, the first of equals.
Equal strings have equal anchors, so a string can be there twice only if the hash of its anchor is.  The strings
around one anchor form a stretch; stretches, not texts, are dealt to shards, by the hash of their
anchor, so that equal strings meet in a shard.  Only stretches whose hash is there again are read out, and of equal
stretches one with their number.

A shard sorts the suffixes of its stretches (Larsson and Sadakane), takes their common prefixes (Kasai), and
a string is there again if its neighbour shares ``length`` bytes or its stretch is there twice.

A hash with very many different stretches (near copies) is not judged at once.  Its strings differ in how far before
the anchor they start; a stretch is halved by that, and all strings of a half hold the same bytes around the
anchor, its core, which is longer than the anchor.  Halves meet by the hash of their core: those whose core is not there
again are done, equal ones become one, and the margins that are left to differ are half as wide.  What still has very many
kinds is halved again; cores of single strings have one kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from wavemill.llm.columns import boxed, column, unboxed
from wavemill.llm.store import Store
from wavemill.llm.suffix_array import common_prefixes, suffix_array

GRAM = 32
#: Bytes hashed at once; 24 bits of a key hold a place.
BLOCK = 1 << 20
#: Bytes of stretches in a shard; different stretches of one hash above which they are halved.
SHARD_BYTES, SPLIT = 1 << 20, 4096
#: Keys of texts that are met by broadcast, at most.
FEW = 200_000

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        n = BLOCK + 4096
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    up, down = _power_tables()
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(text * up[: len(text)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(text) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the stretch of each anchor in texts laid end to end, which end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return np.zeros(0, np.uint64), none, none
    h = gram_hashes(text)
    low = np.uint64((1 << 24) - 1)
    best = _window_minimum((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    at = (best & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    # A string may start where ``length`` bytes of its own text are left.
    marks = np.zeros(len(text) + 1, np.int64)
    fits = ends - starts >= length
    np.add.at(marks, starts[fits], 1)
    np.add.at(marks, ends[fits] - length + 1, -1)
    valid = np.cumsum(marks[: len(at)]) > 0
    change = np.ones(len(at), bool)
    change[1:] = at[1:] != at[:-1]
    change[starts[(starts < len(at)) & (starts > 0)]] = True
    change[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(at)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return h[at[first]], first, last + length


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts in blocks of bounded size: bytes, ends of parts, and of each part its text and where it begins there.

    A long text is cut in parts that share ``length - 1`` bytes, so each of its strings is in one of them.
    """
    parts, size = [], 0

    def block():
        data = np.frombuffer(b"".join(texts[i][s:e] for i, s, e in parts), np.uint8)
        return data, np.cumsum([e - s for _, s, e in parts]), [(i, s) for i, s, _ in parts]

    for i, text in enumerate(texts):
        for s in range(0, max(0, len(text) - length) + 1, BLOCK):
            e = min(len(text), s + BLOCK + length - 1)
            if e - s < length:
                continue
            if size + e - s > BLOCK + 2048 and parts:
                yield block()
                parts, size = [], 0
            parts.append((i, s, e))
            size += e - s
    if parts:
        yield block()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(length: int):
    """``(h, n)`` of the anchors of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()]
            for data, ends, _ in _blocks(texts, length):
                h, n = np.unique(anchors(data, ends, length)[0], return_counts=True)
                yield pa.record_batch([_signed(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


INSTANCE = "h long, d1 long, d2 long, k1 long, k2 long, start long, size long"


def anchor_rows(length: int):
    """Rows of ``INSTANCE``: hash and digest of each stretch, the key of its text, its place there and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            for data, ends, parts in _blocks(texts, length):
                h, start, end = anchors(data, ends, length)
                raw = memoryview(data)
                digest = b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True))
                d = np.frombuffer(digest, "<i8").reshape(-1, 2)
                part = np.searchsorted(ends, start, side="right")
                own = np.asarray(parts)[part]
                k = keys[own[:, 0]]
                place = start - np.concatenate([[0], ends])[part] + own[:, 1]
                cols = [_signed(h), *(pa.array(np.ascontiguousarray(x)) for x in (d[:, 0], d[:, 1], k[:, 0], k[:, 1], place, end - start))]
                yield pa.record_batch(cols, names=["h", "d1", "d2", "k1", "k2", "start", "size"])

    return run


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that are asked for, in batches of bounded size."""
    names = ["shard", "twice", "k1", "k2", "start", "bytes"]
    for big in batches:
        for b in (big.slice(i, 16) for i in range(0, big.num_rows, 16)):
            rows = []
            for text, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(w["shard"], w["twice"], w["k1"], w["k2"], w["start"], text[w["start"] : w["start"] + w["size"]]) for w in wanted]
            for i in range(0, len(rows), 4096):
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], names=names)


PIECE = "g long, d1 long, d2 long, size long, k1 long, k2 long, start long, bytes binary, at int, low int, high int, twice boolean"


def _halves(length: int):
    """Rows of ``PIECE``: the two halves of each piece, by the hash of their core and their digest.

    The strings of a piece start ``low`` to ``high`` bytes before its anchor, which is at ``at``; not all of them need be there.
    A piece without ``at`` is a stretch; its anchor is found as ``anchors`` does.
    """
    low_bits = np.uint64((1 << 24) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [*[pa.int64()] * 7, pa.binary(), *[pa.int32()] * 3, pa.bool_()]
        for big in batches:
            for b in (big.slice(i, 2048) for i in range(0, big.num_rows, 2048)):
                rows = []
                for k1, k2, start, piece, at, low, high, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if at is None:
                        h = gram_hashes(np.frombuffer(piece[:length], np.uint8))
                        at = int(np.argmin((h & ~low_bits) | np.arange(len(h), dtype=np.uint64)))
                    middle = (low + high) // 2
                    for near, far in ((low, middle), (middle + 1, high)):
                        s, last = at - min(far, at), at - max(near, at - (len(piece) - length))
                        if s > last:
                            continue
                        own, core = piece[s : last + length], piece[at - near : at - far + length]
                        g = np.frombuffer(xxhash.xxh3_64_digest(core, near << 32 | far), "<i8")[0]
                        d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(own), "<i8")
                        rows.append((g, d1, d2, len(own), k1, k2, start + s, own, at - s, near, far, twice))
                if rows:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


FOUND = "k1 long, k2 long, start long, stop long"


def repeated_in(texts: list[bytes], twice: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places where a string of ``length`` bytes starts, laid end to end: which are there again, their groups and offsets."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_array(data)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common_prefixes(data, order, length) < length)
    offset = np.cumsum(sizes) - sizes
    # Strings do not cross the end of a stretch.
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    count = np.maximum(sizes - length + 1, 0)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offset[owner]
    g = group[place]
    times = np.bincount(g, weights=1 + twice[owner], minlength=1)
    return place, times[g] >= 2, g, owner


def _judge(length: int):
    """A shard: the strings of its stretches that are there again."""

    def run(shard: pa.Table) -> pa.Table:
        texts, twice = shard["bytes"].to_pylist(), np.array(shard["twice"].to_pylist(), int)
        k1, k2, start = (shard[c].to_numpy() for c in ("k1", "k2", "start"))
        place, again, _, owner = repeated_in(texts, twice, length)
        sizes = np.array([len(t) for t in texts])
        inside = place - (np.cumsum(sizes) - sizes)[owner]
        # Spans of stretches that are there once; the others are known to be repeated whole.
        mine = np.flatnonzero(again & (twice[owner] == 0))
        cut = np.ones(len(mine), bool)
        cut[1:] = (owner[mine[1:]] != owner[mine[:-1]]) | (place[mine[1:]] != place[mine[:-1]] + 1)
        first = mine[cut]
        last = mine[np.append(np.flatnonzero(cut)[1:], len(mine)) - 1] if len(mine) else mine
        o = owner[first]
        cols = (k1[o], k2[o], start[o] + inside[first], start[o] + inside[last] + length)
        return pa.table([pa.array(np.ascontiguousarray(c, np.int64)) for c in cols], names=["k1", "k2", "start", "stop"])

    return run


class _Dealer:
    """Deals kinds of stretches to shards, which get new numbers at each call."""

    def __init__(self, store: Store):
        self.store, self.shards = store, 0

    def deal(self, kinds: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
        """Kinds of keys that have others, with their ``shard``, and those of keys with more than ``SPLIT``, if there are any."""
        varied = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1")
        varied = self.store.keep(varied, "varied")
        few = F.col("kinds") <= SPLIT
        total, most = varied.agg(F.sum(F.when(few, F.col("bytes"))), F.max("kinds")).first()
        shards = int((total or 0) // SHARD_BYTES) + 1
        shard = F.pmod(F.xxhash64(key), F.lit(shards)) + self.shards
        self.shards += shards
        dealt = kinds.join(varied.where(few).select(key), key).withColumn("shard", shard)
        if (most or 0) <= SPLIT:
            return dealt, None
        # Few keys can have so many, so their kinds stay where they are.
        return dealt, kinds.join(F.broadcast(varied.where(~few).select(key)), key)


def _halved(pieces: DataFrame, length: int, store: Store, dealer: _Dealer) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of halves that are there twice, and ``(shard, twice, k1, k2, start, bytes)`` of those to be judged."""
    whole, judged, kind = [], [], ["g", "d1", "d2"]
    while pieces is not None:
        rows = store.keep(pieces.select("k1", "k2", "start", "bytes", "at", "low", "high", "twice").mapInArrow(_halves(length), PIECE), "halves")
        one = F.min(F.struct("k1", "k2", "start", "bytes", "at", "low", "high")).alias("one")
        kinds = store.keep(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.max("size").alias("size"), one), "kinds")
        # A piece of a stretch that is there twice is known to be repeated.
        twice = rows.where("not twice").join(kinds.where("n > 1").select(*kind), kind)
        whole.append(twice.select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("stop")))
        dealt, pieces = dealer.deal(kinds, "g")
        again = (F.col("twice") | (F.col("n") > 1)).alias("twice")
        judged.append(dealt.select("shard", again, "one.k1", "one.k2", "one.start", "one.bytes"))
        pieces = pieces if pieces is None else pieces.select("one.*", again)
    return reduce(DataFrame.unionByName, whole), judged


def repeated_spans(docs: DataFrame, length: int, store: Store) -> DataFrame:
    """``(k1, k2, spans)`` of the texts in ``docs(k1, k2, text)``: the bytes covered by a string that starts elsewhere too.

    Spans are (start, stop), not yet merged.  Texts of one key are copies of each other.
    """
    text = F.col("text")
    counts = docs.select(text).mapInArrow(anchor_counts(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # A table, not an aggregate, so that the join may split a frequent hash.
    again = store.keep(counts.where("n > 1").select("h"), "again")
    found = store.keep(docs.select("k1", "k2", text).mapInArrow(anchor_rows(length), INSTANCE).join(again, "h"), "anchors")
    stretch = ["h", "d1", "d2"]
    # Equal stretches become one with their number, before anything is dealt.
    kinds = found.groupBy(*stretch).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at"), F.max("size").alias("size"))
    kinds = store.keep(kinds, "stretches")
    whole = found.join(kinds.where("n > 1").select(*stretch), stretch).select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("stop"))
    dealer = _Dealer(store)
    wanted, many = dealer.deal(kinds, "h")
    if many is not None:
        wanted = wanted.unionByName(many.withColumn("shard", F.lit(None).cast("long")))
    wanted = wanted.select("at.*", "size", "shard", (F.col("n") > 1).alias("twice"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("shard", "twice", "k1", "k2", "start", "size")).alias("wanted"))
    wanted = store.keep(wanted, "wanted")
    held = docs.select("k1", "k2", text)
    if wanted.count() <= FEW:
        held = held.join(F.broadcast(wanted.select("k1", "k2")), ["k1", "k2"], "left_semi")
    once = held.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])
    cut = once.select("text", "wanted").mapInArrow(_cut_stretches, "shard long, twice boolean, k1 long, k2 long, start long, bytes binary")
    if many is not None:
        cut = store.keep(cut, "cut")
        none = F.lit(None).cast("int")
        pieces = cut.where("shard is null").withColumns({"at": none, "low": F.lit(0), "high": F.lit(length - GRAM)})
        halves, judged = _halved(pieces, length, store, dealer)
        whole, cut = whole.unionByName(halves), reduce(DataFrame.unionByName, judged, cut.where("shard is not null"))
    judged = store.keep(cut.groupBy("shard").applyInArrow(_judge(length), FOUND), "judged")
    spans = whole.unionByName(judged)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with three columns more: ``n_bytes``, ``removed`` (maximal spans of bytes) and ``kept``, the other bytes.

    A byte goes if a string of ``length`` bytes (64 at least) that covers it starts anywhere else too, in the same text or
    in another; all places of such a string go.  Strings are of the UTF-8 bytes of the input; ``kept`` need not be valid
    UTF-8.  Rows with equal texts are copies of each other, whatever their ids; null is an empty text; texts shorter
    than ``length`` lose nothing.  Columns of ``docs`` named like the new ones are replaced; others may have any name.
    An empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    store = Store(docs.sparkSession, "repeats")
    text = column(text_col).cast("string")
    # The key of a text is a hash of it in two parts, so that rows need no id.
    key = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    spans = repeated_spans(docs.where(F.octet_length(text) >= length).select(*key, text.alias("text")), length, store)
    new = ["n_bytes", "removed", "kept"]
    old = [c for c in docs.columns if c not in new]
    rows = docs.select(boxed(docs, old), *key, text.alias("text"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                sizes, gone, left = [], [], []
                for text, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    text, cuts = text or b"", merged([(x["start"], x["stop"]) for x in found or []])
                    edges = [0, *(p for c in cuts for p in c), len(text)]
                    sizes.append(len(text))
                    gone.append([{"start": s, "stop": e} for s, e in cuts])
                    left.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if cuts else text)
                cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(span)), pa.array(left, pa.binary())]
                yield pa.record_batch(cols, names=["row", *new])

    spans_type = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    schema = StructType([joined.schema["row"], StructField("n_bytes", LongType()), StructField("removed", spans_type), StructField("kept", BinaryType())])
    return joined.mapInArrow(run, schema).select(*unboxed(old), *new)
