"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a histogram of integers with bins of at most 1/32 relative width, so sketches of parts
add up to the sketch of the whole, whatever the order, and aggregation merges them before the
shuffle.  Each (language, source) gets fences from its own quartiles; groups that are too
small use their language's merged sketch, or that of all.  Documents are then joined with the
fences of their group and filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wavemill.llm.columns import boxed, column, unboxed
from wavemill.llm.store import Store

SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEATURES = "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Measure: its value (an integer for each document), and the slack added to the fence.
MEASURES: dict[str, tuple[str, int]] = {
    "mean_chars": ("100 * word_chars div greatest(n_words, 1)", 100),
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 100),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_words, 1)", 20),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 100),
}


def _renamed(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside some window of 8 words that is in the text twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n] ^ (ids[i : i + n] << np.uint64(29)))
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    names = ids  # exact names of ever longer windows, for texts that may have repeats
    for half in (1, 2, 4):
        m = len(names) - half
        names = _renamed(names[:m] << np.uint64(32) | names[half : half + m])
    twice = np.bincount(names.astype(np.int64))[names.astype(np.int64)] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def features(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null has no words."""
    raw = raw or b""
    words = raw.split()
    chars = len(raw.decode()) - sum(raw.count(s) for s in SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, all if not given, and the five counts, in one narrow pass.

    Columns with the names of the counts are replaced, others may have any name.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [features(t.as_py()) for t in b.column(1).cast(pa.binary())]
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 5
            yield pa.record_batch([b.column(0), *cols], names=["row", *new])

    rows = docs.select(boxed(docs, own), column(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *(StructField(n, LongType()) for n in new)])
    return rows.mapInArrow(run, schema).select(*unboxed(own), *new)


def bin_of(v: Column) -> Column:
    """Bin of an integer of 0 or more: itself below 64, then 32 bins for each power of two."""
    power = F.length(F.bin(v)) - 1
    return F.when(v < 64, v).otherwise(64 + (power - 6) * 32 + F.floor(v / F.pow(F.lit(2.0), power - 5)).cast("long") - 32).cast("int")


def top_of(b: Column) -> Column:
    """Largest integer in a bin."""
    power = F.floor((b - 64) / 32) + 6
    return F.when(b < 64, b).otherwise(((b - 64) % 32 + 33) * F.pow(F.lit(2.0), power - 5) - 1).cast("long")


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, measure, bin, n)``: the sketches of all groups, from ``(*keys, measure, v)``."""
    return values.groupBy(*keys, "measure", bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up over coarser groups."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, measure, total, q1, q3)``; a group has a bounded number of bins."""
    group = [*keys, "measure"]
    run = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cum = sketches.withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(W.partitionBy(*group)))
    first = lambda part: F.min(F.when(F.col("cum") * 4 >= F.col("total") * part, top_of(F.col("bin"))))
    return cum.groupBy(*group).agg(F.max("total").alias("total"), first(1).alias("q1"), first(3).alias("q3"))


def fences(featured: DataFrame, reach: int = 3, min_group: int = 50) -> DataFrame:
    """``(lang, source, <measure>_lo, <measure>_hi ...)`` for each group of documents that pass the base rules.

    A fence is ``reach`` interquartile ranges and the measure's slack beyond the quartiles of the
    smallest group around the document that holds ``min_group`` documents.  Null languages
    and sources are groups of their own.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(e).alias("v")) for m, (e, _) in MEASURES.items()]))
    values = featured.where("not base_failed and n_words > 0").select("lang", "source", stacked.alias("x")).select("lang", "source", "x.measure", "x.v")
    fine = sketch(values, ["lang", "source"])
    coarse = merge(fine, ["lang"])
    of = quartiles(fine, ["lang", "source"])
    of_lang = quartiles(coarse, ["lang"]).selectExpr("lang as l", "measure as m", "total as total_l", "q1 as q1_l", "q3 as q3_l")
    of_all = quartiles(merge(coarse, []), []).selectExpr("measure as ma", "q1 as q1_a", "q3 as q3_a")
    joined = of.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(F.broadcast(of_all), F.col("measure") == F.col("ma"))
    pick = lambda q: F.when(F.col("total") >= min_group, F.col(q)).when(F.col("total_l") >= min_group, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    joined = joined.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for m, (_, slack) in MEASURES.items():
        for name, edge in (("lo", F.col("q1") - reach * (F.col("q3") - F.col("q1")) - slack), ("hi", F.col("q3") + reach * (F.col("q3") - F.col("q1")) + slack)):
            out.append(F.max(F.when(F.col("measure") == m, edge)).alias(f"{m}_{name}"))
    return joined.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = 3, min_group: int = 50) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every row.

    ``base_failed`` is under 20 words or more than 30 % repeated words.  Of the others those are kept
    whose measures lie within their group's fences.  Null and empty texts have no words and
    fail.  Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "quality")
    cast = {"doc_id": (id_col, "long"), "lang": (lang_col, "string"), "source": (source_col, "string"), "text": (text_col, "string")}
    rows = docs.select(*[column(c).cast(t).alias(n) for n, (c, t) in cast.items()])
    counted = with_features(rows, keep=["doc_id", "lang", "source"]).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    featured = store.keep(counted, "features")
    limits = store.keep(fences(featured, reach, min_group), "fences").withColumnsRenamed({"lang": "lang_f", "source": "source_f"})
    # A row for each group; joined by size, split by adaptive execution where a group is hot.
    judged = featured.join(limits, F.col("lang").eqNullSafe(F.col("lang_f")) & F.col("source").eqNullSafe(F.col("source_f")), "left")
    within = F.lit(True)
    for m, (value, _) in MEASURES.items():
        within = within & F.expr(value).between(F.col(f"{m}_lo"), F.col(f"{m}_hi"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
