"""Token ids in Arrow IPC files of fixed-size-list batches.

A shard is one file in Arrow's IPC file format (the stream format plus a footer of batch
offsets).  Each row is a sequence of equal length: ``ids`` and ``mask`` are fixed-size lists, so
sequence i sits at a computable place and is read without copying from a memory map.  The mask is
true for a token and false for padding at the end of a shard; ``last`` marks the last token of each
document.  Ids are unsigned 16-bit integers where the vocabulary allows, else 32-bit.  A second
small file lists the shard's documents with their first token.  Shards are written by tasks
under names that no other attempt uses, and count only once the manifest, a table that
Spark commits, names them; so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.llm.columns import column
from wavemill.llm.store import Store

#: Sequences in a record batch.
ROWS = 64
MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_tokens long"


class LibraryEncoder:
    """Ids as the tokenizers library gives them, with a bounded cache of what lies between blanks.

    A blank before a visible character always starts a pre-token, so such pieces are encoded apart, and
    a piece's first token is the only one that starts with a blank.  New pieces are given to the
    library many at a time, joined by blanks, and split there again; first pieces of lines likewise
    by line ends.  Texts with runs of white space or with special tokens go to the library whole.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.space = re.compile(r"\s")
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.blank = np.zeros(self.size, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.line_end = vocabulary["\u010a"]
        self.newline = np.array([self.line_end], "<u4").tobytes()
        self.limit = limit
        self.marks = {m: self._ids(m) for m in ".,;:!?"}
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.first_old, self.later_old = {}, {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, known: dict, old: dict, wanted: set, joint: str) -> None:
        """Make sure that ``known`` has the ids of all pieces; those that cannot stand alone get None.

        A full ``known`` becomes ``old``, from which pieces still in use come back.
        """
        if len(known) > self.limit:
            old.clear()
            old.update(known)
            known.clear()
        new = []
        for s in wanted:
            if s not in known:
                if s in old:
                    known[s] = old[s]
                else:
                    new.append(s)
        regular = [s for s in new if s.isalpha() or (s and not self.space.search(s))]
        # A mark after a letter is a pre-token of its own.
        marked = [s for s in regular if s[-1] in self.marks and len(s) > 1 and s[-2].isalpha()]
        alone = {s[:-1] for s in marked}.union(regular).difference(marked, known)
        for s in new:
            known[s] = None
        alone = list(alone)
        for low in range(0, len(alone), 4096):
            some = alone[low : low + 4096]
            groups = [some[i : i + 64] for i in range(0, len(some), 64)]
            texts = [(joint if joint == " " else "") + joint.join(g) for g in groups]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                if joint == " ":
                    ends = [*np.flatnonzero(self.blank[ids])[1:].tolist(), len(ids)]
                    starts = [0, *ends[:-1]]
                else:
                    ends = [*np.flatnonzero(ids == self.line_end).tolist(), len(ids)]
                    starts = [0, *(x + 1 for x in ends[:-1])]
                raw = ids.tobytes()
                for s, x, y in zip(group, starts, ends, strict=True):
                    known[s] = raw[4 * x : 4 * y]
        for s in marked:
            known[s] = known[s[:-1]] + self.marks[s[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split: list[list[tuple[str, list[str]]] | None] = []
        first, later = set(), set()
        for t in texts:
            lines = None
            if t and not any(s in t for s in self.special):
                lines = []
                for line in t.split("\n"):
                    head, *rest = line.split(" ")
                    first.add(head)
                    later.update(rest)
                    lines.append((head, rest))
            split.append(lines)
        self._learn(self.first, self.first_old, first, "\n")
        self._learn(self.later, self.later_old, later, " ")
        get, out = self.later.__getitem__, []
        for text, lines in zip(texts, split, strict=True):
            if lines is None:
                out.append(self._ids(text) if text else b"")
                continue
            try:
                parts = []
                for n, (head, rest) in enumerate(lines):
                    if n:
                        parts.append(self.newline)
                    parts.append(self.first[head])
                    parts.extend(map(get, rest))
                out.append(b"".join(parts))
            except TypeError:  # a piece that cannot stand alone
                out.append(self._ids(text))
        return out


@functools.lru_cache(maxsize=4)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class ShardWriter:
    """Packs documents into sequences of ``length`` and writes them batch by batch."""

    def __init__(self, folder: str, name: str, length: int, vocabulary: int):
        self.system, base = file_system(folder)
        self.system.create_dir(base, recursive=True)
        self.length, self.size = length, ROWS * length
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.paths = [f"{folder}/{name}.{kind}.arrow" for kind in ("ids", "docs")]
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.system.open_output_stream(f"{base}/{name}.{kind}.arrow") for kind in ("ids", "docs")]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.docs_schema), strict=True)]
        self.waiting: list[np.ndarray] = []
        self.ends: list[int] = []
        self.held = self.n_tokens = self.n_docs = 0
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.size:
            self._write(self.held // self.size * self.size)
        if len(self.index) >= 10_000:
            self._write_index()

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        last = np.zeros(len(flat), bool)
        last[self.ends] = True
        rest = flat[n:].copy()
        for low in range(0, min(n, len(flat)), self.size):
            high = min(low + self.size, n)
            self._batch(flat[low:high], last[low:high])
        self.waiting, self.held, self.ends = [rest], len(rest), [e - n for e in self.ends if e >= n]

    def _batch(self, ids: np.ndarray, last: np.ndarray) -> None:
        short = -len(ids) % self.length
        mask = np.pad(np.ones(len(ids), bool), (0, short))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.pad(ids, (0, short)), mask, np.pad(last, (0, short)))]
        self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def _write_index(self) -> None:
        cols = [pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)]
        self.files[1].write_batch(pa.record_batch(cols, schema=self.docs_schema))
        self.index = []

    def close(self) -> None:
        self._write(self.held)
        if self.index:
            self._write_index()
        for x in (*self.files, *self.sinks):
            x.close()


class Shard:
    """Random access to a written shard: by sequence, or by token range."""

    def __init__(self, ids_path: str, docs_path: str, length: int):
        self.length, self.size = length, ROWS * length
        self.ids, self.docs = (pa.ipc.open_file(self._open(p)) for p in (ids_path, docs_path))
        self.cached: tuple[int, pa.RecordBatch | None] = (-1, None)

    @staticmethod
    def _open(path: str):
        system, base = file_system(path)
        return pa.memory_map(base) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(base)

    def _batch(self, n: int) -> pa.RecordBatch:
        if self.cached[0] != n:
            self.cached = (n, self.ids.get_batch(n))
        return self.cached[1]

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids, mask and last of sequence i, as slices of the file."""
        b, row = self._batch(i // ROWS), i % ROWS
        return tuple(b.column(c).values.slice(row * self.length, self.length) for c in range(3))

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them."""
        while n > 0:
            flat = self._batch(start // self.size).column(0).values.to_numpy()[start % self.size :][:n]
            yield flat
            start, n = start + len(flat), n - len(flat)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        for k in range(self.docs.num_record_batches):
            yield from zip(*[c.to_pylist() for c in self.docs.get_batch(k).columns], strict=True)


def write_tokens(docs: DataFrame, path: str, folder: str, length: int = 2048, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order below ``folder``; the manifest, a row for each shard in order.

    Rows with one id are ordered by a hash of their text, so a range of ids that is very
    frequent still splits.  Null and empty texts give just the end id; null ids come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = library(path), None
        tail = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId()
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    out = out or ShardWriter(folder, f"shard-{number:06d}-{uuid.uuid4().hex}", length, max(coder.size, end_id + 1))
                    out.add(doc, np.frombuffer(ids + tail, "<u4"))
        if out:
            out.close()
            values = [number, *out.paths, out.n_docs, out.n_tokens]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "ids_path", "docs_path", "n_docs", "n_tokens"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    ordered = rows.sort(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = Store(docs.sparkSession, "manifest").keep(ordered.mapInArrow(run, MANIFEST), "manifest")
    # One row for each shard: the number of shards follows the number of partitions, not of rows.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, length: int = 2048) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files, a task for each shard on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard, out = Shard(row["ids_path"], row["docs_path"], length), []
                for doc, start, n in shard.documents():
                    crc = 0
                    for view in shard.tokens(start, n):
                        crc = zlib.crc32(view.astype("<u4"), crc)
                    out.append((doc, row["shard_start"] + start, n, crc))
                    if len(out) == 20_000:
                        yield table(out)
                        out = []
                if out:
                    yield table(out)

    def table(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "ids_path", "docs_path", "shard_start").repartition(max(1, manifest.count()), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, length: int = 2048, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to files in the shared folder and describe each from what was read back.

    An empty table writes no shard and gives no rows; repeated rows are separate documents.
    """
    store = Store(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, path, store.path("shards"), length, end_id, id_col, text_col), length)
