"""Connected components by alternating large and small stars, on edges held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.store import Store

#: A centre with more than this share of all edges is hot, so there are at most 2 / SHARE hot centres.
SHARE = 0.001
#: Edges that a centre has at least to be hot.
LEAST = 64


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _with_minimum(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``edges(u, v)`` with the ``m`` of their ``u`` in ``low(u, m, n)``.

    Hot centres, few by their definition, are met by broadcast.  Their edges then pass the shuffle of the
    other join dealt by ``v``, under a key that matches nothing; no other key has more edges than the limit.
    """
    limit = max(LEAST, int(SHARE * n))
    hot = F.broadcast(low.where(F.col("n") > limit).select("u", F.col("m").alias("hot")))
    cold = low.where(F.col("n") <= limit).select(F.col("u").alias("key"), F.lit(0).alias("side"), F.col("m").alias("cold"))
    at = edges.join(hot, "u", "left").withColumns({"key": F.when(F.col("hot").isNull(), F.col("u")).otherwise(F.col("v")), "side": F.col("hot").isNotNull().cast("int")})
    return at.join(cold, ["key", "side"], "left").select("u", "v", F.coalesce("hot", "cold").alias("m"))


def connected_components(edges: DataFrame, store: Store, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the smallest node reachable.

    Each round rewrites the edges as stars whose centres are local minima.  Both star steps
    are an aggregation to a minimum (combined before the shuffle) and a join back, in which centres with very
    many neighbours are kept apart.  No component is ever gathered in one place.  A round's table is
    deleted when the next one is written.  Self edges and nulls are ignored; an empty input gives
    an empty result.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = store.keep(links, "links")
    before = _signature(links)
    if before[0] == 0:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    count = F.count(F.lit(1)).alias("n")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), count)
        large = _with_minimum(both, low, before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), count)
        both_ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        small = _with_minimum(large, low, before[0]).select(both_ends).select("e.*").where("u <> v")
        old, links = links, store.keep(small.distinct(), "links")
        after = _signature(links)
        store.drop(old, large)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
