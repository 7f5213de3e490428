"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

The fingerprint has 64 bits over word shingles.  The search uses 2**(radius + 1) - 1 bit
masks derived from one vector of radius + 1 bits per position: a pair that differs in at most
``radius`` positions agrees under at least one mask, because as many linear equations always
leave a non-zero solution.  So no link is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.llm.columns import column
from wavemill.llm.graph import connected_components
from wavemill.llm.store import Store

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that one very long text needs a fixed amount of memory.
BLOCK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text; 0 for null or a text without words.

    Words are runs of anything but ASCII space and tab to carriage return, with A-Z in lower
    case.  Shorter texts are one shingle.  A bit is set if it is set in over half the hashes.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    k = min(words, len(found))
    n = len(found) - k + 1
    digest, sums, start = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    for low in range(0, n, BLOCK):
        hashes = []
        for end in ends[low + k - 1 : min(low + BLOCK, n) + k - 1]:
            hashes.append(digest(joined[start:end], SEED))
            start = ends[low + len(hashes) - 1] + 1
        block = np.array(hashes, dtype="<u8")
        sums += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(x.as_py(), words) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks over 64 bits of which one at least keeps clear of any ``radius`` positions."""
    n = 1 << (radius + 1)
    vectors = [1 + (i * 11) % (n - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n)]


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning edges of the links among the fingerprints of one bucket."""
    us, vs, left = [], [], fps
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for low in range(0, len(frontier), 256):
                near |= (np.bitwise_count(frontier[low : low + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            frontier, left = left[near], left[~near]
            us.append(frontier)
            vs.append(np.full(len(frontier), root, np.uint64))
    return us, vs


def _bucket_edges(radius: int):
    """Function over rows sorted by (t, key): a spanning forest of each bucket's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def edges(t, key, fp):
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(t)])
            fp = fp.view(np.uint64)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            us, vs = [fp[two]], [fp[two + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                a, b = _forest(fp[s : s + n], radius)
                us += a
                vs += b
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate([r, np.asarray(c).astype(np.int64)]) for r, c in zip(rest, b.columns, strict=True)]
            t, key, _ = cols
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield edges(*[c[:cut] for c in cols])
        if len(rest[0]):
            yield edges(*rest)

    return run


def links(distinct: DataFrame, store: Store, radius: int = 4, dense: int = 16384) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the fingerprints linked by chains within ``radius``.

    A bucket of up to ``dense`` fingerprints is compared inside one task, which emits a
    spanning forest only.  In a larger bucket each fingerprint goes instead to every midpoint within
    radius / 2 over the bits that the mask leaves free; two fingerprints share a midpoint just
    if they are within the radius.  That costs a fixed number of rows for each fingerprint, so
    no bucket is ever compared all against all, and none is capped.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    spark, masks = distinct.sparkSession, covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks)]))
    keyed = distinct.select("fp", tables.alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes a side by its source, not by the row for each mask: unhinted it would broadcast one of them.
    members = store.keep(keyed.hint("merge").join(sizes, ["t", "key"]), "buckets")
    small = members.where(F.col("n") <= dense).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = small.mapInArrow(_bucket_edges(radius), "u long, v long")
    big = members.where(F.col("n") > dense).select("t", "fp")
    if not big.isEmpty():
        flips = []
        for t, m in enumerate(masks):
            free = [i for i in range(BITS) if not m >> i & 1]
            flips += [(t, _signed(sum(1 << i for i in c))) for r in range(radius // 2 + 1) for c in combinations(free, r)]
        # A fixed table: it depends on the masks alone, about 530 rows for each of 31 masks.
        moves = F.broadcast(spark.createDataFrame(flips, "t short, flip long"))
        at = big.join(moves, "t").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp").distinct()
        hubs = at.groupBy("z").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = found.unionByName(at.join(hubs, "z").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct())
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, dense: int = 16384) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row with the smallest id of its class.

    Documents with equal fingerprints are one class from the start, however many there are; only
    distinct fingerprints are compared.  Null and empty texts have fingerprint 0 and form a class
    like any other.  A null id stays null and never becomes a component id while others exist.
    Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "simhash")
    fps = store.keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = store.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct.select("fp"), store, radius, dense), store)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = store.keep(labelled.join(lowest, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the document of the smallest id of each near-duplicate class; columns unchanged.

    Rows that share an id are one document: the one with the smallest text stays.  Rows with a
    null id have no place in a class and stay.
    """
    return keep_smallest(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def keep_smallest(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the document of the smallest id of each of ``classes`` of (doc_id, component_id).

    Only ids that go, and those that several rows share, are looked for among the rows: where few, by broadcast, so that
    no text moves; beyond the broadcast threshold by a join on the id.  Rows with a null id stay.
    """
    ids = classes.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = Store(docs.sparkSession, "kept").keep(ids.where("n > 1 or not stays"), "marked")
    shared = marked.where("n > 1 and stays").select(F.col("doc_id").alias(id_col))
    rank = "__rank"
    while rank in docs.columns:
        rank += "_"
    own = [column(c) for c in docs.columns]
    one = W.partitionBy(column(id_col)).orderBy(column(text_col), F.xxhash64(*[c.cast("string") for c in own]))
    first = docs.join(shared, id_col, "left_semi").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    return docs.join(marked.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").select(*own).unionByName(first.select(*own))
