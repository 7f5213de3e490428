"""Analysis windows as small tables and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cosine-sum coefficients of the window kinds, signs alternating.
COSINES = {
    "rect": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flat_top": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def window_table(spark: SparkSession, kind: str, n: int, sym: bool = True, beta: float | None = None) -> DataFrame:
    """``(n, w)`` of a window of n points, symmetric or periodic; Kaiser windows take ``beta``."""
    span = float(max(1, n - 1 if sym else n))
    i = F.col("id").cast("double")
    if kind == "kaiser":
        bessel = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(49)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda s, k: F.struct((s["t"] * F.pow(x / 2 / k, F.lit(2.0))).alias("t"), (s["s"] + s["t"] * F.pow(x / 2 / k, F.lit(2.0))).alias("s")), lambda s: s["s"])  # noqa: E731, E501
        b, r = F.lit(float(beta)), 2 * i / span - 1
        w = bessel(b * F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))) / bessel(b)
    else:
        w = F.lit(0.0)
        for k, c in enumerate(COSINES[kind]):
            w = w + (-1) ** k * c * F.cos(2 * np.pi * k * i / span)
    return spark.range(n).select(F.col("id").cast("int").alias("n"), w.alias("w"))


def window_array(kind: str, n: int, sym: bool = True) -> np.ndarray:
    at = 2 * np.pi * np.arange(n) / max(1, n - 1 if sym else n)
    return sum((-1) ** k * c * np.cos(k * at) for k, c in enumerate(COSINES[kind])) * np.ones(n)
