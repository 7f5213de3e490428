"""Near copies of five-word shingle sets, Jaccard similarity 0.8 or more: by SimHash and covering search, then exactly.

Every set has a fingerprint of 64 bits, and the covering search of ``simhash`` links fingerprints; links are confirmed on
whole sets.  Sets of this similarity may differ in more bits than a covering search can reach, so the links that it leaves are
found exactly; pairs that it has linked are not compared again.

For these candidates come from prefix filtering: under any one order of all shingles, two sets of similarity
0.8 or more share a shingle among the first ``n - ceil(0.8 n) + 1`` of each.  So no link is missed,
whatever the data; the order, rare shingles first, decides only the work.  Sets that share a shingle are
held against each other by bitmaps of the sets' parities, which differ in no more places than the sets do;
so no similar pair is lost, and sets that only share a passage go, also where the sample behind the order is too small
a part of the table to know the passage.  What is left is confirmed on whole sets.  Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.llm import simhash
from wavemill.llm.columns import column
from wavemill.llm.graph import connected_components
from wavemill.llm.store import Store

WORDS = 5
SEED = 42
#: Texts from which the frequency of shingles is estimated; it orders shingles and never decides a link.
SAMPLE = 32_768
#: A shingle expected in this many times ``dense`` texts is hot.
HOT = 4
#: Sets that share a shingle up to which all their pairs are held against each other by bitmaps, and up to which that is done in one task.
FEW, MANY = 16, 16_384
#: Sets of a large group that all others of it are held against, and the name of those that none is similar to.
PIVOTS, REST = 8, "rest"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """Hashes of words, a bounded number of them kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = h
        return h


_HASHES = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words as in ``simhash``, shorter texts are one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += w[i : i + n] * _MULTIPLIERS[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _digest(s: np.ndarray) -> int:
    return simhash._signed(xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes(), SEED))


def similar(inter, n, m):
    """Whether sets of ``n`` and ``m`` with ``inter`` in common have similarity 0.8 or more; in whole numbers."""
    return 9 * inter >= 4 * (n + m)


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is set if it is set in over half of their hashes; signed."""
    sums = np.zeros(simhash.BITS, np.int64)
    for low in range(0, len(s), simhash.BLOCK):
        block = s[low : low + simhash.BLOCK].astype("<u8")
        sums += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(s), bitorder="little").view("<i8")[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, in two to four times as many places as there are shingles."""
    size = 1 << max(6, int(2 * len(s) - 1).bit_length() if len(s) else 6)
    places = (s & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of shingles that two sets differ in at least, by their bitmaps; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _by_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, nu, nv, bu, bv) the pairs whose sets can be similar."""
    for b in batches:
        nu, nv = (np.asarray(b.column(c)).astype(np.int64) for c in (2, 3))
        d = np.fromiter((least_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, b.num_rows)
        yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(9 * d <= nu + nv))


def _texts(b: pa.RecordBatch, i: int) -> Iterator[bytes | None]:
    return (x.as_py() for x in b.column(i).cast(pa.binary()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, sims, sizes, counts, maps = [], [], [], [], []
        for t in _texts(b, 1):
            s = shingles(t)
            fps.append(_digest(s))
            sims.append(fingerprint(s))
            sizes.append(len(t or b""))
            counts.append(len(s))
            maps.append(bitmap(s))
        cols = [b.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(maps, pa.binary()), pa.array(sims, pa.int64())]
        yield pa.record_batch(cols, names=["doc_id", "fp", "size", "n", "map", "sim"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in _texts(b, 0):
            yield pa.record_batch([pa.array(shingles(t).view(np.int64))], names=["token"])


def _common(rows: DataFrame, n: int, sample: int = SAMPLE, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded sample of texts hold, sorted, and how many hold them."""
    share = min(1.0, sample / max(1, n))
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    found = taken.mapInArrow(_tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, held = np.asarray(found["token"]).astype(np.int64).view(np.uint64), np.asarray(found["n"]).astype(np.int64)
    order = np.argsort(token)
    return token[order], held[order]


def prefix(s: np.ndarray, common: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not known as common by hash, then the others from the rarest."""
    p = len(s) - (4 * len(s) + 4) // 5 + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    rare = s[~known]
    if len(rare) >= p:
        return rare[:p]
    rest, n = s[known], held[at[known]]
    return np.concatenate([rare, rest[np.lexsort((rest, n))]])[:p]


def _prefixes(common: np.ndarray, held: np.ndarray, hot: np.ndarray):
    """Function over texts: a row for each shingle of the prefix of each set.

    A shingle among the ``hot`` is no bucket: the set is linked to a node that stands for the shingle, a row with
    -1 for its length, so that sets which share a very frequent shingle never meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            for t in _texts(b, 0):
                s = shingles(t)
                fp = _digest(s)
                if not len(s) or fp in seen:
                    continue
                seen.add(fp)
                p = prefix(s, common, held)
                n = np.where(np.isin(p, hot), -1, len(s)).astype(np.int32)
                yield pa.record_batch([pa.array(p.view(np.int64)), pa.array(np.full(len(p), fp, np.int64)), pa.array(n), pa.array(np.arange(len(p), dtype=np.int32))], names=["token", "fp", "n", "pos"])

    return run


def _forest(near) -> tuple[list[int], list[int]]:
    """Spanning edges of a graph of ``len(near)`` nodes; ``near(i)`` marks the neighbours of a node."""
    us, vs, left = [], [], np.ones(len(near), bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        queue = [root]
        while queue and left.any():
            i = queue.pop()
            new = np.flatnonzero(near(i) & left)
            left[new] = False
            us += new.tolist()
            vs += [i] * len(new)
            queue += new.tolist()
    return us, vs


class _Maps:
    """Pairs of sets whose lengths and bitmaps allow them to be similar; bitmaps of one length lie in one matrix."""

    def __init__(self, n: np.ndarray, maps: list[bytes]):
        self.n, self.size = n, np.array([len(m) for m in maps])
        # Lengths of similar sets differ by less than a half, so their bitmaps by one fold at most.
        self.places = {int(k): np.flatnonzero(self.size == k) for k in np.unique(self.size)}
        self.maps = {k: np.frombuffer(b"".join(maps[i] for i in at), "<u8").reshape(len(at), -1) for k, at in self.places.items()}
        self.row = np.empty(len(n), np.int64)
        for at in self.places.values():
            self.row[at] = np.arange(len(at))

    def __len__(self) -> int:
        return len(self.n)

    def __call__(self, i: int) -> np.ndarray:
        found, k = np.zeros(len(self), bool), int(self.size[i])
        own = self.maps[k][self.row[i]]
        for size, at in self.places.items():
            if size == k:
                differ = self.maps[size] ^ own
            elif size == 2 * k:
                differ = self.maps[size][:, : k // 8] ^ self.maps[size][:, k // 8 :] ^ own
            elif 2 * size == k:
                differ = self.maps[size] ^ own[: size // 8] ^ own[size // 8 :]
            else:
                continue
            n = self.n[at]
            found[at] = (9 * np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= n + self.n[i]) & similar(np.minimum(n, self.n[i]), n, self.n[i])
        return found


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (token, fp, n, map) sorted by token: edges that connect the sets of a bucket which chains of bitmaps allow to be similar."""
    key, fps, ns, maps = None, [], [], []

    def edges():
        u, v = _forest(_Maps(np.array(ns, np.int64), maps)) if len(fps) > 1 else ([], [])
        f = np.array(fps, np.int64)
        u, v = f[np.array(u, int)], f[np.array(v, int)]
        return pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    for b in batches:
        for token, fp, n, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if token != key:
                if len(fps) > 1:
                    yield edges()
                key, fps, ns, maps = token, [], [], []
            fps.append(fp)
            ns.append(n)
            maps.append(m)
    if len(fps) > 1:
        yield edges()


class _Sets:
    """Pairs of whole sets of similarity 0.8 or more, by lists of the sets that hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.rows = np.split(flat, np.cumsum(self.n)[:-1])
        self.holders = owner[np.argsort(flat, kind="stable")]
        self.starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(ids)))]

    def __len__(self) -> int:
        return len(self.n)

    def __call__(self, i: int) -> np.ndarray:
        low, size = self.starts[self.rows[i]], self.starts[self.rows[i] + 1] - self.starts[self.rows[i]]
        at = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return similar(np.bincount(self.holders[at], minlength=len(self)), self.n, self.n[i])


#: Kinds of rows of ``_candidates``: a pair that can be similar, an edge of a group, a shingle and a set that holds it.
PAIR, EDGE, HELD = 0, 1, 2


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (token, fp): of each bucket all pairs that can be similar; of larger ones the shingle beside each set, in place of a pair."""
    rest: list[np.ndarray] = [np.empty(0, np.int64)] * 4

    def rows(token, fp, n, pos):
        found = {PAIR: ([], []), EDGE: ([], []), HELD: ([], [])}

        def add(kind, u, v):
            found[kind][0].append(u)
            found[kind][1].append(v)

        node = n < 0
        add(EDGE, np.maximum(fp[node], token[node]), np.minimum(fp[node], token[node]))
        token, fp, n, pos = token[~node], fp[~node], n[~node], pos[~node]
        if len(token):
            one = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
            token, fp, n, pos = token[one], fp[one], n[one], pos[one]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            # Rows of one bucket are sorted by their set.
            two = starts[sizes == 2]
            two = two[similar(np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]), n[two], n[two + 1])]
            add(PAIR, fp[two + 1], fp[two])
            for s, k in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                f = fp[s : s + k]
                if k <= FEW:
                    i, j = np.triu_indices(k, 1)
                    rest, size = n[s : s + k] - pos[s : s + k], n[s : s + k]
                    ok = similar(np.minimum(rest[i], rest[j]), size[i], size[j])
                    add(PAIR, f[j[ok]], f[i[ok]])
                elif k <= MANY:
                    add(HELD, token[s : s + k], f)
                else:
                    add(EDGE, f[1:], np.full(k - 1, f[0]))
        u, v = (np.concatenate([x for pair in found.values() for x in pair[c]]) for c in (0, 1))
        kind = np.repeat(list(found), [sum(map(len, pair[0])) for pair in found.values()]).astype(np.int32)
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(kind)], names=["u", "v", "kind"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([r, np.asarray(c).astype(np.int64)]) for r, c in zip(rest, b.columns, strict=True)]
        new = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        cut = int(new[-1]) + 1 if len(new) else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield rows(*[c[:cut] for c in cols])
    if len(rest[0]):
        yield rows(*rest)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (root, i, j, fp): a spanning forest of the similar pairs of each group."""
    key, fps, sets = None, [], []

    def edges():
        u, v = _forest(_Sets(sets)) if len(sets) > 1 else ([], [])
        f = np.array(fps, np.int64)
        return pa.record_batch([pa.array(f[np.array(u, int)]), pa.array(f[np.array(v, int)])], names=["u", "v"])

    for b in batches:
        for root, i, j, fp, t in zip(*(b.column(c).to_pylist() for c in range(4)), _texts(b, 4), strict=True):
            if (root, i, j) != key:
                if len(sets) > 1:
                    yield edges()
                key, fps, sets = (root, i, j), [], []
            if fps and fps[-1] == fp:
                continue
            s = shingles(t)
            if _digest(s) == fp:
                fps.append(fp)
                sets.append(s)
    if len(sets) > 1:
        yield edges()


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (root, block, flag), a block's pivots first: an edge for each set that is similar to a pivot."""
    key, pivots = None, []
    for b in batches:
        us, vs = [], []
        for root, i, member, fp, t in zip(*(b.column(c).to_pylist() for c in range(4)), _texts(b, 4), strict=True):
            if (root, i) != key:
                key, pivots = (root, i), []
            s = shingles(t)
            if _digest(s) != fp:
                continue
            if not member:
                pivots.append((fp, s))
                continue
            for other, p in pivots:
                if other != fp and similar(len(np.intersect1d(s, p, assume_unique=True)), len(s), len(p)):
                    us.append(fp)
                    vs.append(other)
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _large(members: DataFrame, rows: DataFrame, store: Store, block: int) -> tuple[DataFrame, DataFrame]:
    """Groups of ``members(fp, first_id, size, root, k)`` of more than a block: links found at once, and what is still to be compared.

    All sets are held against ``PIVOTS`` of their group, which takes time in proportion.  Sets that hang together by
    these links need no comparing with each other: only blocks of different classes meet, and blocks of those
    that no pivot is similar to.
    """
    first = F.row_number().over(W.partitionBy("root").orderBy("fp"))
    pivots = members.withColumn("o", first).where(F.col("o") <= PIVOTS)
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int").alias("i")
    all_ = members.select(F.col("first_id").alias("doc_id"), "root", own, F.lit(1).alias("member"), "fp")
    there = pivots.select(F.col("first_id").alias("doc_id"), "root", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.lit(0).alias("member"), "fp")
    held = rows.join(store.keep(all_.unionByName(there), "pivots"), "doc_id").select("root", "i", "member", "fp", "text")
    star = held.repartition("root", "i").sortWithinPartitions("root", "i", "member", "fp").mapInArrow(_against_pivots, "u long, v long")
    star = store.keep(star.distinct(), "star")
    kin = connected_components(star, store).select(F.col("node").alias("fp"), F.col("root").cast("string").alias("kin"))
    named = members.drop("k").join(kin, "fp", "left").withColumn("kin", F.coalesce("kin", F.lit(REST)))
    named = store.keep(named, "kin")
    # At most PIVOTS classes and the rest in a group.
    parts = named.groupBy("root", "kin").agg(F.ceil((F.sum("size") + 1) / F.lit(block / 2)).cast("int").alias("n"))
    around = parts.groupBy("root").agg(F.collect_list(F.struct("kin", "n")).alias("parts"))
    spread = named.join(parts, ["root", "kin"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).join(F.broadcast(around) if around.count() <= 10_000 else around, "root")
    spread = spread.withColumn("other", F.explode("parts")).where((F.col("kin") != F.col("other.kin")) | (F.col("kin") == REST))
    spread = spread.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("other.n") - 1)))
    mine, theirs = F.concat_ws(":", "kin", "b"), F.concat_ws(":", "other.kin", "c")
    return star, spread.select(F.col("first_id").alias("doc_id"), "root", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), "fp")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs ``(u, v)`` those whose sets ``(fp, n, map)`` can be similar by their bitmaps."""
    one, two = (sets.withColumnsRenamed({"fp": x, "n": f"n{x}", "map": f"m{x}"}) for x in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(_by_bitmaps, "u long, v long")


def _by_fingerprints(distinct: DataFrame, rows: DataFrame, store: Store, block: int) -> DataFrame:
    """Edges ``(u, v)`` of similar sets that the covering search over fingerprints finds, confirmed on whole sets.

    Sets with one fingerprint are held against the first of them, and first ones of linked fingerprints against each
    other; so the work is in proportion to the links.  What is held against one set lies in pieces of at most a block.
    """
    sims = store.keep(distinct.groupBy("sim").agg(F.min("fp").alias("hub")), "fingerprints")
    one, two = (sims.withColumnsRenamed({"sim": x, "hub": f"hub_{x}"}) for x in "uv")
    between = simhash.links(sims.select(F.col("sim").alias("fp")), store).distinct().join(one, "u").join(two, "v").select(F.greatest("hub_u", "hub_v").alias("u"), F.least("hub_u", "hub_v").alias("v"))
    own = distinct.join(sims, "sim").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    close = store.keep(_close(own.unionByName(between).distinct(), distinct.select("fp", "n", "map")), "alike")
    sized = close.join(distinct.select(F.col("fp").alias("u"), F.col("first_id").alias("doc_id"), "size"), "u")
    pieces = store.keep(sized.groupBy("v").agg(F.ceil((F.sum("size") + 1) / F.lit(block)).cast("int").alias("k")), "pieces")
    members = sized.join(pieces, "v").select("doc_id", F.col("v").alias("root"), F.pmod(F.xxhash64("u"), F.col("k")).cast("int").alias("i"), F.lit(1).alias("member"), F.col("u").alias("fp"))
    firsts = distinct.select(F.col("fp").alias("v"), F.col("first_id").alias("doc_id")).join(pieces, "v")
    firsts = firsts.select("doc_id", F.col("v").alias("root"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.lit(0).alias("member"), F.col("v").alias("fp"))
    held = rows.join(store.keep(members.unionByName(firsts), "against"), "doc_id").select("root", "i", "member", "fp", "text")
    return held.repartition("root", "i").sortWithinPartitions("root", "i", "member", "fp").mapInArrow(_against_pivots, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 256, block: int = 16_000_000) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row with the smallest id of its class.

    Two texts are linked if their shingle sets have similarity 0.8 or more; classes are chains of
    links.  Fingerprints are searched first, the links they miss are found by shared shingles.  ``fp`` is a hash of the set, and texts with equal sets, as are all without words, are one
    class from the start.  The groups of candidates are compared whole, each in one task; a group of more than
    ``block`` bytes is first held against a few of its sets, and then only blocks are compared that this has not
    linked.  Rows with a null id have a null in place of an id; repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "jaccard")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    fps = store.keep(rows.mapInArrow(_digests, "doc_id long, fp long, size long, n long, map binary, sim long"), "digests")
    distinct = store.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.max("size").alias("size"), F.max("n").alias("n"), F.max("map").alias("map"), F.max("sim").alias("sim")), "distinct")
    sets = distinct.select("fp", "n", "map")
    kin = store.keep(_by_fingerprints(distinct, rows, store, block).distinct(), "linked")
    known = store.keep(connected_components(kin, store), "known")
    distinct = distinct.drop("n", "map", "sim")
    total = fps.count()
    common, held = _common(rows, total)
    hot = common[held * max(1.0, total / SAMPLE) > HOT * dense]
    firsts = rows.select("text").mapInArrow(_prefixes(common, held, hot), "token long, fp long, n int, pos int")
    dealt = firsts.repartition(F.when(F.col("n") < 0, F.col("fp")).otherwise(F.col("token"))).sortWithinPartitions("token", "fp")
    candidates = store.keep(dealt.mapInArrow(_candidates, "u long, v long, kind int").distinct(), "candidates")
    of = lambda kind: candidates.where(F.col("kind") == kind).select("u", "v")
    # A shingle that is not known as common may be shared by hundreds of sets that only have a passage in common: bitmaps part them.
    shared = of(HELD).select(F.col("u").alias("token"), F.col("v").alias("fp")).join(sets, "fp").select("token", "fp", "n", "map")
    alike = shared.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(_alike, "u long, v long")
    # Pairs within a class of fingerprints are linked already; a group that is compared whole keeps all its members.
    one, two = (known.withColumnsRenamed({"node": x, "root": f"k{x}"}) for x in "uv")
    new = of(PAIR).join(one, "u", "left").join(two, "v", "left").where("ku is null or kv is null or ku <> kv").select("u", "v")
    close = _close(new, sets)
    groups = connected_components(close.unionByName(alike).unionByName(of(EDGE)), store)
    members = store.keep(groups.select(F.col("node").alias("fp"), "root").join(distinct, "fp"), "members")
    blocks = members.groupBy("root").agg(F.ceil((F.sum("size") + 1) / F.lit(block)).cast("int").alias("k")).where("k > 1")
    blocks = store.keep(blocks, "blocks")
    whole = members.join(blocks, "root", "left_anti").select(F.col("first_id").alias("doc_id"), "root", F.lit("").alias("i"), F.lit("").alias("j"), "fp")
    star = None
    if not blocks.isEmpty():
        star, more = _large(members.join(blocks, "root"), rows, store, block)
        whole = whole.unionByName(more)
    placed = store.keep(whole, "placed")
    held = rows.join(placed, "doc_id").select("root", "i", "j", "fp", "text")
    found = held.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp").mapInArrow(_confirmed, "u long, v long")
    found = found.unionByName(kin)
    roots = connected_components(found if star is None else found.unionByName(star), store)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = store.keep(labelled.join(lowest, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the document of the smallest id of each class; rows with one id and with none as in ``simhash``."""
    return simhash.keep_smallest(docs, near_copies(docs, id_col, text_col, **how), id_col, text_col)
