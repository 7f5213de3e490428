"""Uncompressed RIFF and RF64 files read by ranges of bytes.

A range of a file is read by a task of its own: it reads the header, a few hundred bytes, and the blocks of samples
whose first byte lies in the range, so that borders of ranges may lie anywhere, inside a frame too.  No
file is ever held whole, and files may have any length.

``PcmSource`` is a Spark data source over a folder; ``read_ranges`` serves tables of files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File extensions taken in.
EXTENSIONS = ("flac", "wav", "aiff", "aif", "alac", "m4a", "ape", "wv", "dsf", "dff")
BLOCKS = "path string, track_id string, ch int, block_no long, rate int, channels int, bits int, x array<double>, error string"
SCHEMA = pa.schema([("path", pa.string()), ("track_id", pa.string()), ("ch", pa.int32()), ("block_no", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("x", pa.list_(pa.float64())), ("error", pa.string())])
#: Samples of a block and bytes of a range.
BLOCK, RANGE = 65_536, 64 << 20
#: Bytes that opening a file counts as, so that small files are dealt by their number.
OPENING = 256 << 10
#: A size in a header that says nothing.
UNKNOWN = 0xFFFFFFFF


class Header(NamedTuple):
    rate: int
    channels: int
    kind: int
    bits: int
    start: int
    size: int

    @property
    def width(self) -> int:
        return self.bits // 8 * self.channels


def read_header(f: Any, length: int) -> Header:
    """The form of the samples, where they start and how many bytes there are; ValueError says what is wrong.

    Chunks before the samples are stepped over.  Samples of unknown or too large a size go on to the file's end.
    """
    f.seek(0)
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, data, wide = 12, None, None, None
    while data is None or form is None:
        if at + 8 > length:
            raise ValueError("no format or data chunk")
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(size, 40))
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"ds64":
            wide = struct.unpack_from("<Q", f.read(16), 8)[0]
        elif name == b"data":
            size = wide if size == UNKNOWN and wide is not None else size
            data = (at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    kind, channels, rate, _, _, bits = form
    if not channels or not data[1]:
        raise ValueError("no channels" if not channels else "no samples")
    if (kind, bits) not in ((3, 32), (1, 16), (1, 24), (1, 32)):
        raise ValueError(f"format {kind} with {bits} bits is not read")
    return Header(rate, channels, kind, bits, *data)


def decode(data: bytes, h: Header) -> np.ndarray:
    """Samples (frames, channels) between -1 and 1."""
    data = data[: len(data) // h.width * h.width]
    if h.kind == 3:
        x = np.frombuffer(data, "<f4").astype(float)
    elif h.bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v >> 23) << 24)) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{h.bits // 8}") / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels)


def _failed(path: str, message: str) -> pa.RecordBatch:
    row = {"path": path, "track_id": path.rsplit("/", 1)[-1], "error": message}
    return pa.RecordBatch.from_pylist([row], schema=SCHEMA)


def range_blocks(f: Any, path: str, length: int, low: int, high: int, block: int) -> Iterator[pa.RecordBatch]:
    """The blocks that start in the bytes from ``low`` to ``high``, a batch for each block with a row for each channel.

    What is wrong with the file is said by its first range, what cannot be read by the range it lies in.
    """
    try:
        h = read_header(f, length)
    except (ValueError, struct.error) as e:
        if low == 0:
            yield _failed(path, str(e))
        return
    step, frames, name = block * h.width, h.size // h.width, path.rsplit("/", 1)[-1]
    first = max(0, -(-(low - h.start) // step))
    for n in range(first, -(-frames // block)):
        at = h.start + n * step
        if at >= high:
            break
        want = min(step, frames * h.width - n * step)
        try:
            f.seek(at)
            data = f.read(want)
            if len(data) < want:
                raise OSError(f"{want - len(data)} bytes are missing")
        except OSError as e:
            yield _failed(path, f"bytes {at} to {at + want}: {e}")
            continue
        x = decode(data, h)
        c = h.channels
        values = pa.ListArray.from_arrays(pa.array(np.arange(c + 1) * len(x), pa.int32()), pa.array(x.T.ravel()))
        same = [pa.array([v] * c, t) for v, t in ((n, pa.int64()), (h.rate, pa.int32()), (c, pa.int32()), (h.bits, pa.int32()))]
        yield pa.record_batch([pa.array([path] * c), pa.array([name] * c), pa.array(range(c), pa.int32()), *same, values, pa.nulls(c, pa.string())], schema=SCHEMA)


def file_system(path: str) -> tuple[Any, str]:
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(path: str, length: int, low: int, high: int, block: int) -> Iterator[pa.RecordBatch]:
    system, inside = file_system(path)
    try:
        f = system.open_input_file(inside)
    except OSError as e:
        if low == 0:
            yield _failed(path, str(e))
        return
    with f:
        yield from range_blocks(f, path, length, low, high, block)


class Ranges(InputPartition):
    """Ranges ``(path, length, low, high)`` of one task."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(len(ranges))
        self.ranges = ranges


def plan_ranges(files: list[tuple[str, int]], size: int, opening: int = 0) -> list[list[tuple[str, int, int, int]]]:
    """Ranges of at most ``size`` bytes; small files, each with so many bytes for its opening, share a task up to that size."""
    tasks, room = [], 0
    for path, length in files:
        for low in range(0, max(length, 1), size):
            high = min(low + size, length) if low + size < length else max(length, 1)
            if not tasks or room < high - low + opening:
                tasks.append([])
                room = size
            tasks[-1].append((path, length, low, high))
            room -= high - low + opening
    return tasks


class PcmReader(DataSourceReader):
    """Plans ranges from names and lengths alone; no file is opened before its tasks run."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.block = int(options.get("block", BLOCK))
        self.size = int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, inside = file_system(self.path)
        info = system.get_file_info(inside)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=self.recursive))
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        files = sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.extension.lower() in EXTENSIONS)
        return [Ranges(r) for r in plan_ranges(files, self.size, OPENING)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, length, low, high in partition.ranges:
            yield from _read(path, length, low, high, self.block)


class PcmSource(DataSource):
    """``spark.read.format("wavemill_pcm")`` with options ``recursive``, ``block`` (samples) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "wavemill_pcm"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)


def read_pcm_files(spark: SparkSession, path: str, recursive: bool = False, block: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """Blocks of every channel of the media files below ``path``, each range of bytes in a task of its own.

    A file that cannot be read, or a part of one, is a row with its error.  A folder without media files gives no rows.
    """
    spark.dataSource.register(PcmSource)
    options = {"recursive": str(recursive).lower(), "block": str(block), "rangeBytes": str(range_bytes)}
    return spark.read.format("wavemill_pcm").options(**options).load(path)


def read_ranges(files: DataFrame, block: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """The same for a table ``(path, length)``: its rows become ranges, which are dealt evenly to tasks; small ones share one."""
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("low")
    ranges = files.select("path", F.col("length").cast("long").alias("length"), low)
    asked, total = files.agg(F.sum(F.floor(F.col("length") / range_bytes) + 1), F.sum("length")).first()
    # Every range opens its file, so small ranges share a task as small files do.
    load = (total or 0) + (asked or 0) * OPENING
    tasks = min(asked or 1, max(-(-load // max(range_bytes, RANGE)), files.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _read(path, length, at, at + range_bytes, block)

    return ranges.repartition(int(min(tasks, 100_000))).mapInArrow(run, BLOCKS)
