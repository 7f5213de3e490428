"""Line dedup by levelled sorted runs of line hashes.

Runs are tables of (line hash, documents, largest id) sorted by hash, and a hash is in one run only.  A new batch
of documents is reduced to its own sorted hashes and merge-anti-joined with the runs: hashes that no run
holds become the batch's run; for the others an update is noted.  Runs wait on levels; when
a level holds ``fanout`` of them they are compacted into one run of the next level.  At the end the updates,
which hold repeated lines only, are added to the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wavemill.llm.columns import boxed, column, texts, unboxed
from wavemill.llm.store import Store

BLANKS = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: A line held by more than this share of all line rows is hot, so there are at most 1 / SHARE hot lines; and the fewest rows of one.
SHARE, LEAST = 0.001, 1000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without ASCII white space around it and with A-Z in lower case; None if it is short."""
    key = line.strip(BLANKS)
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


def key_hash(key: bytes) -> int:
    """128 bits, so that different lines of a corpus of any size do not meet."""
    return xxhash.xxh3_128_intdigest(key)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(h1, h2, doc_id)`` for each distinct long line of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 512) for i in range(0, big.num_rows, 512)):
                ids, hashes = [], bytearray()
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if doc is None or text is None:
                        continue
                    keys = {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                    for k in keys:
                        hashes += key_hash(k).to_bytes(16, "little")
                    ids += [doc] * len(keys)
                pair = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineRuns:
    """The runs of one corpus; a document belongs to one batch."""

    def __init__(self, store: Store, fanout: int = 2):
        self.store, self.fanout = store, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.updates: list[DataFrame] = []

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows dealt by hash already, sorted within each part."""
        return self.store.keep(rows.sortWithinPartitions(*KEY), name)

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(h1, h2, doc_id)``: a run of its new hashes, updates for the others; compact levels that are full."""
        batch = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))
        if self._runs():
            batch = self._write(batch, "batch")
            fresh = self._write(self.unseen(batch), "run-0")
            self.updates.append(self.store.keep(batch.hint("merge").join(fresh.hint("merge"), KEY, "left_anti"), "updates"))
            self.store.drop(batch)
        else:
            fresh = self._write(batch, "run-0")
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(self._union(old).repartition(*KEY), f"run-{level + 1}")
            self.store.drop(*old)
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        return rows

    def all(self) -> DataFrame | None:
        """One row for each line hash over all runs, with all updates."""
        if not self._runs():
            return None
        rows = self._union(self._runs())
        if not self.updates:
            return rows
        more = self._union(self.updates).groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("last_id").alias("later"))
        joined = rows.hint("merge").join(more.hint("merge"), KEY, "left")
        return joined.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_id", "later").alias("last_id"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of a batch whose hash no run holds: a merge anti-join with each run."""
        for run in self._runs():
            lines = lines.hint("merge").join(run.hint("merge"), KEY, "left_anti")
        return lines


def _holders(lines: DataFrame, repeated: DataFrame, limit: int) -> DataFrame:
    """``(h1, h2, doc_id, last_id)`` of the documents that hold repeated lines.

    Lines held by more than ``limit`` documents are few, as that is a share of all lines, and are met by broadcast; their
    rows then pass the merge join dealt by document, under a key that matches nothing.
    """
    hot = F.broadcast(repeated.where(F.col("n_docs") > limit).select(*KEY, F.col("last_id").alias("hot")))
    cold = repeated.where(F.col("n_docs") <= limit).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(0).alias("side"), F.col("last_id").alias("cold"))
    met = F.col("hot").isNotNull()
    at = lines.join(hot, KEY, "left").withColumns({"k1": F.when(met, F.col("doc_id")).otherwise(F.col("h1")), "k2": F.col("h2"), "side": met.cast("int")})
    found = at.hint("merge").join(cold.hint("merge"), ["k1", "k2", "side"], "left")
    return found.select(*KEY, "doc_id", F.coalesce("hot", "cold").alias("last_id")).where("last_id is not null")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with three columns more: ``n_lines``, ``n_dropped`` and ``kept``, the remaining text.

    A line whose key has ``min_chars`` code points and is held by ``min_docs`` documents is kept
    in the document of the largest id only.  Documents go through the runs in ``batches`` dealt by id.
    Rows that share an id are one document.  Null and empty texts are one empty line.  Rows with
    a null id keep all their lines.  A line twice in a document is lost or kept both times.  Columns of ``docs``
    named like the new ones are replaced; others may have any name.  An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "lines")
    # The batch of a document is the folder its lines are written to, so each batch reads its own lines only.
    lines = line_table(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = store.path("lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    runs = LineRuns(store, fanout)
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n).drop("batch"))
    repeated = store.keep(runs.all().where(F.col("n_docs") >= min_docs), "repeated")
    dropped = _holders(lines, repeated, max(LEAST, int(SHARE * lines.count()))).where("doc_id < last_id")
    # At most the distinct lines of one document meet here.
    dropped = dropped.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    new = ["n_lines", "n_dropped", "kept"]
    old = [c for c in docs.columns if c not in new]
    rows = docs.select(boxed(docs, old), column(id_col).cast("long").alias("id"))
    joined = rows.join(dropped, F.col("id") == F.col("doc_id"), "left").select("row", "drop")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 512) for i in range(0, big.num_rows, 512)):
                counts, drops, left = [], [], []
                for text, drop in zip(texts(b.column(0), text_col).cast(pa.binary()).to_pylist(), b.column(1), strict=True):
                    split = (text or b"").split(b"\n")
                    kept = split
                    if drop.is_valid:
                        fields = drop.values
                        pair = np.stack([fields.field(0).to_numpy(), fields.field(1).to_numpy()], axis=1)
                        gone = {x.tobytes() for x in pair.astype("<i8")}
                        kept = [x for x in split if (k := line_key(x, min_chars)) is None or key_hash(k).to_bytes(16, "little") not in gone]
                    counts.append(len(split))
                    drops.append(len(split) - len(kept))
                    left.append(b"\n".join(kept).decode())
                cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(left, pa.string())]
                yield pa.record_batch(cols, names=["row", *new])

    schema = StructType([joined.schema["row"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    return joined.mapInArrow(rebuild, schema).select(*unboxed(old), *new)
