"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Findings that say a track has been through a lossy codec, with the codec's name.
LOSSY = {"Mp3Transcode": "MP3", "AacTranscode": "AAC", "OpusTranscode": "Opus", "OggVorbisTranscode": "Ogg Vorbis", "LossyTranscode": None, "UpsampledLossyTranscode": None}


def _log10(x: Column) -> Column:
    return F.log10(x)


def amp_db(x: Column, floor: float = -200.0) -> Column:
    return F.when(x > 1e-10, 20 * _log10(x)).otherwise(F.lit(floor))


def db_amp(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def dbfs(x: Column) -> Column:
    """Decibels of full scale; -120 for 0 and below."""
    return F.when(x > 0, 20 * _log10(x)).otherwise(F.lit(-120.0))


def lufs_from_power(p: Column) -> Column:
    return F.when(p > 0, -0.691 + 10 * _log10(p)).otherwise(F.lit(-70.0))


def lufs_from_rms(r: Column) -> Column:
    return F.when(r > 0, -0.691 + 20 * _log10(r)).otherwise(F.lit(-70.0))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * _log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def quantize(x: Column, bits: int, mode: str = "inflate") -> Column:
    """Integers of a sample: ``dither``, ``inflate``, ``mqa`` or ``fixed24``, as the analyses define them."""
    half = 1 << (bits - 1)
    if mode == "dither":
        if bits not in (16, 24):
            raise ValueError("dither is defined for 16 and 24 bits")
        return F.round(x * (half - 1)).cast("int")
    if mode == "inflate":
        return F.greatest(F.least(F.round(x * half), F.lit(float(half - 1))), F.lit(float(-half))).cast("int")
    if mode == "mqa":
        return (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * (half - 1)).cast("int")
    if mode == "fixed24":
        return F.round(x * 8388607).cast("int")
    raise ValueError(f"no such mode: {mode}")


def format_rate(hz: Column) -> Column:
    """``48 kHz`` or ``44.1 kHz``."""
    whole = F.format_string("%d kHz", (hz / 1000).cast("int"))
    return F.when(hz % 1000 == 0, whole).otherwise(F.format_string("%.1f kHz", hz / 1000.0))


def is_lossy(defect: Column) -> Column:
    return F.coalesce(defect.isin(*LOSSY), F.lit(False))


def codec_name(defect: Column, codec: Column | None = None) -> Column:
    """The codec of a lossy finding; a general one names its own."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, name in LOSSY.items():
        out = out.when(defect == kind, F.lit(name) if name else (codec if codec is not None else F.lit(None).cast("string")))
    return out


def silence_gate(x: Column, least: float = 1e-5) -> Column:
    return F.abs(x) >= least


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    return samples.where(F.col("idx") < n)
