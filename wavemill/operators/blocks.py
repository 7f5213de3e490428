"""Ordered work on long channels: blocks with a halo instead of one window over a whole track."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CH = ["track_id", "ch"]
BLOCK = 65_536


def with_halo(df: DataFrame, back: int, ahead: int, block: int = BLOCK, at: str = "idx") -> DataFrame:
    """``df`` with ``__own``, the block a row lies in, and ``__b``, the block it serves: rows within ``ahead`` and ``back`` places of an edge serve the neighbour too."""
    if max(back, ahead) > block:
        raise ValueError("offsets reach beyond a block")
    own = F.floor(F.col(at) / block)
    place = F.col(at) - own * block
    also = [F.when(place >= block - back, own + 1)] * bool(back) + [F.when((place < ahead) & (own > 0), own - 1)] * bool(ahead)
    return df.withColumn("__own", own).withColumn("__b", F.explode(F.array_compact(F.array(own, *also))))


def with_whole(near: DataFrame, keys: list[str], wholes: dict[str, tuple[Callable[..., Column], Column]]) -> DataFrame:
    """Rows of ``with_halo`` with sums or extremes over their whole key, ``{name: (F.sum, column)}``; rows without a key go.

    Each block counts its own rows, and the few rows of blocks are summed by key and met by block: the rows themselves are never
    dealt by key, of which there may be few.  Both sides read one shuffle.
    """
    near = near.repartition(*keys, "__b")
    own = F.col("__b") == F.col("__own")
    parts = near.groupBy(*keys, "__b").agg(*(f(F.when(own, c)).alias(name) for name, (f, c) in wholes.items()))
    parts = parts.select(*keys, "__b", *(f(name).over(W.partitionBy(*keys)).alias(name) for name, (f, _) in wholes.items()))
    return near.join(parts, [*keys, "__b"])


def neighbours(df: DataFrame, value: str, offsets: list[int], block: int = BLOCK, keys: list[str] | None = None, at: str = "idx", wholes: dict[str, tuple[Callable[..., Column], Column]] | None = None) -> DataFrame:
    """``df`` with ``{value}_m{k}`` or ``{value}_p{k}``: the value k places before or after; null beyond the ends; and ``wholes``, see ``with_whole``.

    Places of a key must follow without gaps.  Each block also gets the edge rows of its neighbours, so
    a window never spans more than a block and its halo, however long the key's rows are.
    """
    keys = keys or CH
    spread = with_halo(df, max(0, -min(offsets)), max(0, max(offsets)), block, at)
    if wholes:
        spread = with_whole(spread, keys, wholes)
    w = W.partitionBy(*keys, "__b").orderBy(at)
    cols = {f"{value}_{'m' if o < 0 else 'p'}{abs(o)}": F.lag(value, -o).over(w) if o < 0 else F.lead(value, o).over(w) for o in offsets if o}
    return spread.withColumns(cols).where(F.col("__b") == F.col("__own")).drop("__own", "__b")


def numbered(df: DataFrame, keys: list[str], order: list[str], cell: Column | None = None, out: str = "idx") -> DataFrame:
    """``df`` with the place of each row within its key, from 0.

    With ``cell``, a number that never falls as the order rises, rows are counted by cell, the counts
    are summed over the cells, and ranks are taken within a cell, so a long key has no single task.
    """
    if cell is None:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    celled = df.withColumn("__cell", cell)
    before = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    starts = celled.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(W.partitionBy(*keys, "__cell").orderBy(*order)) - 1
    return celled.withColumn("__in", within).join(starts, [*keys, "__cell"]).withColumn(out, F.col("__start") + F.col("__in")).drop("__cell", "__start", "__in")
