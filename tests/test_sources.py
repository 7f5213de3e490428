import io
import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from wavemill.sources import media, pcm


def riff(x, rate=8000, bits=16):
    x = np.atleast_2d(np.asarray(x, float).T).T
    if bits == 24:
        v = np.round(x.ravel() * (1 << 23)).astype(np.int32) & 0xFFFFFF
        data = b"".join(int(i).to_bytes(3, "little") for i in v)
    elif bits == 32:
        data = x.astype("<f4").tobytes()
    else:
        data = np.round(x * 32768).astype("<i2").tobytes()
    c = x.shape[1]
    fmt = struct.pack("<HHIIHH", 3 if bits == 32 else 1, c, rate, rate * c * bits // 8, c * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_pcm_round_trip(bits):
    x = np.arange(-8, 8).reshape(8, 2) / 16
    rate, got, y = media.read_pcm(riff(x, bits=bits))
    assert (rate, got) == (8000, bits) and np.allclose(x, y)


def test_scan_and_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.WAV").write_bytes(riff(np.linspace(-0.5, 0.5, 100)))
    (tmp_path / "b.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "sub" / "c.wav").write_bytes(riff(np.zeros((10, 2))))
    top = media.scan_media(spark, str(tmp_path))
    assert top.count() == 2 and media.scan_media(spark, str(tmp_path), recursive=True).count() == 3
    blocks = media.ingest_pcm(top, block=40).collect()
    good = [b for b in blocks if b.error is None]
    assert sorted(len(b.x) for b in good) == [20, 40, 40] and {b.rate for b in good} == {8000}
    assert media.keep_errors(media.ingest_pcm(top)).count() == 1
    assert media.with_digest(top).where("length(md5) = 32").count() == 2
    long = media.with_digest(media.scan_media(spark, str(tmp_path), longest=100)).collect()
    assert {r.md5 for r in long} == {r.md5 for r in media.with_digest(top).collect()} and sum(r.content is None for r in long) == 1
    assert {r.claimed_bits for r in media.with_claimed_bits(top).collect()} == {24}


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", 44100)], "source_file string, source_sample_rate int")
    media.save_manifest(df, str(tmp_path / "m"))
    assert media.load_manifest(spark, str(tmp_path / "m")).first().source_sample_rate == 44100


def joined(rows):
    """Samples of each (file, channel) from blocks in order."""
    out = {}
    for r in sorted((r for r in rows if r.error is None), key=lambda r: (r.track_id, r.ch, r.block_no)):
        out.setdefault((r.track_id, r.ch), []).extend(r.x)
    return out


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_ranges_agree_with_the_whole_read(spark, tmp_path, bits):
    """Borders of ranges lie inside frames; each range is read by a task of its own."""
    x = np.random.default_rng(bits).integers(-100, 100, (5000, 2)) / 128
    (tmp_path / "long.wav").write_bytes(riff(x, bits=bits))
    (tmp_path / "short.wav").write_bytes(riff(x[:7], bits=bits))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing" * 500)
    want = {(f"{n}.wav", c): v[:, c].tolist() for n, v in (("long", x), ("short", x[:7])) for c in (0, 1)}
    for size in (1001, 7777, 1 << 20):
        df = pcm.read_pcm_files(spark, str(tmp_path), block=300, range_bytes=size)
        rows = df.selectExpr("*", "spark_partition_id() AS task").collect()
        assert joined(rows) == want and [r.error for r in rows if r.error] == ["not a RIFF WAVE file"]
        if size < 1 << 20:
            assert len({r.task for r in rows if r.track_id == "long.wav"}) > 2
        listed = media.ingest_pcm(media.scan_media(spark, str(tmp_path)), block=300, range_bytes=size)
        assert joined(listed.collect()) == want and media.keep_errors(listed).count() == 1
        assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_headers():
    x = np.arange(40).reshape(20, 2) / 64
    plain = riff(x)
    start = plain.index(b"data")
    listed = plain[:start] + b"LIST" + struct.pack("<I", 5) + b"notes\0" + plain[start:]
    wide = b"RF64" + plain[4:12] + b"ds64" + struct.pack("<IQQQI", 28, 0, 80, 0, 0) + plain[12:start] + b"data" + struct.pack("<I", pcm.UNKNOWN) + plain[start + 8 :]
    for raw in (plain, listed, wide, plain + b"tail"):
        assert np.allclose(media.read_pcm(raw)[2], x)
    assert len(media.read_pcm(plain[:-3])[2]) == 19
    for raw, message in ((b"", "not a"), (plain[:20], "buffer"), (plain[:start], "no format"), (riff(np.zeros((0, 1))), "no samples")):
        with pytest.raises((ValueError, struct.error), match=message):
            media.read_pcm(raw)


def test_damaged_ranges_are_error_rows():
    """What cannot be read is a row with its bytes; the blocks around it are there."""

    class Damaged(io.BytesIO):
        def read(self, n=-1):
            if n > 100 and 1000 <= self.tell() < 1400:
                raise OSError("bad sector")
            return super().read(n)

    raw = riff(np.arange(1000) / 1024)
    got = [b for low in range(0, len(raw), 333) for b in pcm.range_blocks(Damaged(raw), "x/a.wav", len(raw), low, low + 333, 100)]
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["error"] for r in rows if r["error"]] == ["bytes 1044 to 1244: bad sector", "bytes 1244 to 1444: bad sector"]
    assert sorted(r["block_no"] for r in rows if not r["error"]) == [0, 1, 2, 3, 4, 7, 8, 9]
    short = [r for b in pcm.range_blocks(io.BytesIO(raw[:-50]), "a.wav", len(raw), 0, len(raw), 100) for r in b.to_pylist()]
    assert short[-1]["error"].endswith("50 bytes are missing")


def test_ranges_are_packed():
    tasks = pcm.plan_ranges([("a", 10), ("b", 0), ("c", 25), ("d", 5)], 10)
    assert tasks == [[("a", 10, 0, 10)], [("b", 0, 0, 1)], [("c", 25, 0, 10)], [("c", 25, 10, 20)], [("c", 25, 20, 25), ("d", 5, 0, 5)]]
    assert pcm.plan_ranges([], 10) == []


def test_many_small_files_share_tasks(spark):
    """Tasks follow the bytes and the openings of files, not their number alone."""
    files = spark.range(3000).select(F.concat(F.lit("/nowhere/"), "id").alias("path"), F.lit(1000).cast("long").alias("length"))
    got = pcm.read_ranges(files)
    assert got.rdd.getNumPartitions() <= 3000 * (pcm.OPENING + 1000) // pcm.RANGE + 1 + spark.sparkContext.defaultParallelism
    tasks = pcm.plan_ranges([(str(i), 1000) for i in range(3000)], pcm.RANGE, pcm.OPENING)
    assert 10 <= len(tasks) <= 20 and sum(map(len, tasks)) == 3000


def test_long_files_are_written_in_pieces(spark, tmp_path):
    """Pieces come in any order and from many tasks; a file has them in the order of their places."""
    want = {f"f{k}.wav": [bytes([k, i % 251]) * (i % 7) for i in range(3000)] for k in range(3)}
    rows = [(name, i, p) for name, ps in want.items() for i, p in enumerate(ps)]
    np.random.default_rng(1).shuffle(order := list(range(len(rows))))
    pieces = spark.createDataFrame([rows[i] for i in order], "name string, place long, content binary").repartition(5)
    got = {r["name"]: r["length"] for r in media.write_pieces(pieces, str(tmp_path / "out")).collect()}
    assert got == {name: len(b"".join(ps)) for name, ps in want.items()}
    assert all((tmp_path / "out" / name).read_bytes() == b"".join(ps) for name, ps in want.items())
    assert media.write_pieces(pieces.limit(0), str(tmp_path / "none")).count() == 0


def test_no_row_holds_a_long_file(spark):
    """The files of the query are dealt in pieces of a fixed number of samples."""
    from wavemill.plans import files

    rows = files.long_pieces(spark, "/root/testdata/sf0.01").selectExpr("name", "place", "length(content) AS n").collect()
    assert max(r.n for r in rows) == 3 * files.PIECE and sum(r.n for r in rows if r.place >= 0) == 3 * 60_000
    assert len(rows) > 3 * 5 and sorted(r.n for r in rows if r.place < 0) == [44] * 3


def test_small_ranges_share_tasks(spark):
    files = spark.createDataFrame([("/nowhere/a", 50_000_000), ("/nowhere/b", 10)], "path string, length long")
    got = pcm.read_ranges(files, range_bytes=10_007).rdd.getNumPartitions()
    assert got <= 5000 * (pcm.OPENING + 10_007) // pcm.RANGE + 2 + spark.sparkContext.defaultParallelism
