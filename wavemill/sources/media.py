"""Media files as tables: listing, digests, claimed depths, raw PCM blocks; manifests."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wavemill.sources import pcm

EXTENSIONS = pcm.EXTENSIONS
# Extensions whose depth is taken to be 24 bits.
DEEP = ("flac", "wav", "aiff", "aif", "alac", "m4a", "ape", "wv")
# The fields of a manifest.
MANIFEST = (
    "source_file string, source_sample_rate int, source_bit_depth int, "
    "dithering_tests array<struct<filename: string, method: string, scale: double, output_bits: int, expected_detection: string>>, "
    "resampling_tests array<struct<filename: string, original_rate: int, target_rate: int, engine: string, expected_detection: string>>"
)
#: Bytes of a file read at once.
PIECE = 1 << 20
#: Longest file in bytes whose content is read; a cell of a table holds no more.
LONGEST = 2_000_000_000


def scan_media(spark: SparkSession, path: str, recursive: bool = False, longest: int = LONGEST) -> DataFrame:
    """``(path, length, content, ext)`` of media files, told by their names before any is opened; no match is no row.

    Content is read only where it is used, and is null for files longer than ``longest``.
    """
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{{{','.join(either)}}}").load(path)
    files = files.withColumn("ext", F.lower(F.element_at(F.split("path", r"\."), -1)))
    short, long = files.where(F.col("length") <= longest), files.where(F.col("length") > longest)
    return short.select("path", "length", "content", "ext").unionByName(long.select("path", "length", F.lit(None).cast("binary").alias("content"), "ext"))


def write_media(files: DataFrame, folder: str) -> DataFrame:
    """Write ``(name, content)`` below a folder that all executors share; ``(name, length)`` of what was written.

    A file is written under its own name, so a task that runs twice writes the same file twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        system.create_dir(base, recursive=True)
        for p in batches:
            for name, raw in zip(p["name"], p["content"], strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(raw))
            yield pd.DataFrame({"name": p["name"], "length": [len(c) for c in p["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, length long")


def write_pieces(pieces: DataFrame, folder: str) -> DataFrame:
    """The same for files in pieces ``(name, place, content)``: those of a file are written one after the other, in the order of ``place``.

    A file is one stream and so one task's, which holds a batch of pieces at a time, however long the file is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        system.create_dir(base, recursive=True)
        name, out, length = None, None, 0
        try:
            for b in batches:
                for own, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    if own != name:
                        if out is not None:
                            out.close()
                            yield pa.record_batch([pa.array([name]), pa.array([length])], names=["name", "length"])
                        name, out, length = own, system.open_output_stream(f"{base}/{own}"), 0
                    length += out.write(raw.as_buffer())
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.record_batch([pa.array([name]), pa.array([length])], names=["name", "length"])

    return pieces.select("name", "place", "content").repartition("name").sortWithinPartitions("name", "place").mapInArrow(run, "name string, length long")


def with_digest(tracks: DataFrame) -> DataFrame:
    """MD5 of the whole file; where there is no content, as of files too long for a cell, the file is read through in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for path in b.column(at).to_pylist():
                system, inside = pcm.file_system(path)
                digest = hashlib.md5()
                with system.open_input_stream(inside) as f:
                    while part := f.read(PIECE):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests)], names=[*b.schema.names, "md5"])

    at = tracks.columns.index("path")
    held, long = tracks.where(F.col("content").isNotNull()), tracks.where(F.col("content").isNull())
    return held.withColumn("md5", F.md5("content")).unionByName(long.mapInArrow(run, StructType([*tracks.schema.fields, StructField("md5", StringType())])))


def with_claimed_bits(tracks: DataFrame) -> DataFrame:
    """``claimed_bits`` from the sample or coded depth if known, else from the extension, and whether it was inferred."""
    have = set(tracks.columns)
    own = F.col("bits_per_sample") if "bits_per_sample" in have else F.lit(None).cast("int")
    coded = F.col("coded_bits") if "coded_bits" in have else F.lit(None).cast("int")
    guess = F.when(F.lower("ext").isin(*DEEP), 24).otherwise(16)
    return tracks.withColumn("claimed_bits", F.coalesce(own, coded, guess)).withColumn("bit_depth_inferred", own.isNull())


def read_pcm(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and samples (frames, channels) of an uncompressed RIFF file held whole; ValueError says what is wrong."""
    h = pcm.read_header(io.BytesIO(raw), len(raw))
    return h.rate, h.bits, pcm.decode(raw[h.start : h.start + h.size], h)


def ingest_pcm(tracks: DataFrame, block: int = pcm.BLOCK, range_bytes: int = pcm.RANGE) -> DataFrame:
    """Blocks of every channel of the files in ``(path, length)``, read by ranges of bytes; content is not used.

    A file that cannot be read, or a part of one, is a row with its error.
    """
    return pcm.read_ranges(tracks.select("path", "length"), block, range_bytes)


def keep_errors(results: DataFrame) -> DataFrame:
    """Tracks that failed, with the message; failures are rows, not exceptions."""
    return results.where("error is not null").select("path", "error")


def save_manifest(df: DataFrame, path: str) -> None:
    """A JSON record for each row."""
    df.write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, schema: str = MANIFEST, multi_line: bool = False) -> DataFrame:
    """Records of ``save_manifest``, one on each line, or with ``multi_line`` files that hold one record each."""
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
