"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source token shares are raised to an exponent between 0 (uniform) and 1 (as found) and
normalised.  The exponent is bisected: the largest one whose weights reach a target entropy, and
the smallest one under which no source is repeated more often than allowed; the larger of the two is taken.  The
weights are then realised within a token budget: each source's documents are dealt by a keyed hash into
blocks, as many as its tokens ask for, blocks and documents within them are permuted anew for each pass
over the source, whole passes are emitted as long as the budget lasts, and the last pass stops where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.llm.columns import boxed, column, unboxed
from wavemill.llm.store import Store

#: Halvings of the interval of exponents, and how many of them a job does at once.
STEPS, LEVELS = 50, 10
#: Sources up to which their weights are broadcast; a plain join is used beyond.
SMALL_SOURCES = 100_000
#: Passes that are listed at once.
PASSES = 1024
#: Tokens of a block on average: what one task sorts.  Blocks of a group: what one task sums.
BLOCK_TOKENS, GROUP = 1 << 16, 4096


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII space and tab to carriage return, counted as tokens; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """``(source, total, docs)``: tokens and documents of sources that have tokens."""
    return sized.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("docs")).where("total > 0")


def _walk(lo: float, hi: float, up: dict[int, bool]) -> tuple[float, float]:
    """``LEVELS`` halvings of an interval; ``up`` says at each of its inner points, in equal steps, where to go."""
    low, high = 0, 1 << LEVELS
    for _ in range(LEVELS):
        middle = (low + high) // 2
        low, high = (middle, high) if up[middle] else (low, middle)
    step = (hi - lo) / (1 << LEVELS)
    return lo + low * step, lo + high * step


def exponent(totals: DataFrame, tokens: int, sources: int, budget: float, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent of ``totals(source, total)``, which have ``tokens`` and ``sources`` in all.

    Each job sums over the sources for all exponents that the next ``LEVELS`` halvings can ask for; a few numbers
    for each exponent come back, however many sources there are.
    """
    p = totals.select((F.col("total") / F.lit(float(tokens))).alias("p"))
    a = F.col("at.a")
    ends = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    points = F.sequence(F.lit(0), F.lit(1 << LEVELS))
    known: dict[str, bool] = {}
    for _ in range(STEPS // LEVELS):
        grids = []
        for kind, (lo, hi) in ends.items():
            grids.append(F.transform(points, _point(kind, lo, (hi - lo) / (1 << LEVELS))))
        powers = p.select("p", F.explode(F.concat(*grids)).alias("at")).select("p", "at.kind", "at.i", a.alias("a"), F.pow("p", a).alias("x"))
        sums = powers.groupBy("kind", "i", "a").agg(F.sum("x").alias("norm"), F.sum(F.col("x") * F.col("a") * F.log("p")).alias("moment"), F.max(F.pow("p", F.col("a") - 1)).alias("worst"))
        entropy = F.log("norm") - F.col("moment") / F.col("norm") >= F.lit(1.0 if target_entropy is None else float(target_entropy)) * F.log(F.lit(float(sources)))
        repeats = F.col("worst") * F.lit(budget / tokens) / F.col("norm") > F.lit(float(max_repeats or 0))
        rows = sums.select("kind", "i", F.when(F.col("kind") == "entropy", entropy).otherwise(repeats).alias("up")).collect()
        up = {kind: {r["i"]: r["up"] for r in rows if r["kind"] == kind} for kind in ends}
        known = known or {"flat": up["entropy"][1 << LEVELS], "free": not up["repeats"][0]}
        ends = {kind: _walk(*ends[kind], up[kind]) for kind in ends}
    by_repeats = 0.0 if max_repeats is None or known["free"] else ends["repeats"][1]
    by_entropy = 0.0 if target_entropy is None else 1.0 if known["flat"] else ends["entropy"][0]
    return round(max(by_entropy, by_repeats), 9)


def _point(kind: str, lo: float, step: float):
    return lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), (F.lit(lo) + i * F.lit(step)).alias("a"))


def mixture(totals: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """``(source, total, exponent, weight, quota)`` of each source of a stored table of totals.

    ``target_entropy`` is a share of the largest possible entropy: the result is the largest exponent
    whose weights reach it.  ``max_repeats`` bounds passes over a source: without a target the result is the
    smallest exponent at which every quota is within that many times its source's tokens (1, the shares
    as they are, where none is).  With both the limit goes first: the target is met as far as it allows.
    ``quota`` is the weight's part of ``budget`` in whole tokens, one at least, so that no source is lost; under a limit it is never more than ``max_repeats``
    times the source's tokens, so a budget that is too large for the corpus is not used up.
    """
    if target_entropy is None and max_repeats is None:
        raise ValueError("give target_entropy, max_repeats or both")
    whole = totals.agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("sources")).first()
    if not whole["sources"]:
        return totals.selectExpr("source", "total", "0D as exponent", "0D as weight", "0L as quota")
    tokens, sources = whole
    budget = float(tokens if budget is None else budget)
    a = exponent(totals, tokens, sources, budget, target_entropy, max_repeats)
    norm = totals.agg(F.sum(F.pow(F.col("total") / F.lit(float(tokens)), F.lit(a)))).first()[0]
    weight = F.pow(F.col("total") / F.lit(float(tokens)), F.lit(a)) / F.lit(norm)
    # Of the weight as it is: rounded as shown, that of a small source could be nothing.
    quota = F.greatest(F.floor(weight * F.lit(budget)), F.lit(1))
    if max_repeats is not None:
        quota = F.least(quota, F.floor(F.col("total") * F.lit(float(max_repeats))))
    return totals.select("source", "total", F.lit(a).alias("exponent"), F.round(weight, 9).alias("weight"), quota.cast("long").alias("quota"))


def _starts(blocks: DataFrame) -> DataFrame:
    """``(source, epoch, block, before)``: tokens of a pass before each block of ``(source, epoch, block, n)``, summed by groups of blocks first."""
    key = ["source", "epoch"]
    earlier = lambda of, by: F.coalesce(F.sum("n").over(W.partitionBy(*of).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = blocks.withColumn("g", F.floor(F.col("block") / GROUP))
    groups = grouped.groupBy(*key, "g").agg(F.sum("n").alias("n")).withColumn("base", earlier(key, "g")).drop("n")
    inner = grouped.withColumn("in_group", earlier([*key, "g"], "block"))
    return inner.join(groups, [*key, "g"]).select(*key, "block", (F.col("base") + F.col("in_group")).alias("before"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    seed: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, all if not given, realised to the mixture, with ``epoch``, ``position``, ``tokens``, ``weight`` and ``exponent``.

    Each source is emitted in passes (``epoch`` from 0), under a limit at most ``max_repeats`` of them, without one as
    many as its weight asks for; in the last pass documents are taken, in that pass's permutation, while
    the tokens before them are below the rest of the quota.  ``position`` is the tokens of the source before the document in its pass.  ``budget`` is in tokens,
    the corpus's own count if not given.  A source is summed by block first, so no source's documents meet in
    one task.  A null source is a source like any other; texts without tokens, null ones too, follow the
    document before them in the permutation.  Sources without tokens give no rows.  Repeated rows
    are separate documents; rows that agree in id and text may take each other's places.  Columns of ``docs``
    with the names of the new ones are replaced, others may have any name.  An empty table gives no rows.
    """
    new = ["epoch", "position", "tokens", "weight", "exponent"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = F.coalesce(F.concat(F.lit("s:"), column(source_col).cast("string")), F.lit("null")).alias("source")
    text = column(text_col).cast("string")
    rows = docs.select(boxed(docs, own), source, n_words(text).alias("tokens"), F.coalesce(column(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(text).alias("tie"))
    store = Store(docs.sparkSession, "mixing")
    totals = store.keep(source_totals(rows), "totals")
    weights = store.keep(mixture(totals, budget, target_entropy, max_repeats).join(totals.select("source", "docs"), "source"), "weights").where("quota > 0")
    if weights.count() <= SMALL_SOURCES:
        weights = F.broadcast(weights)
    planned = rows.join(weights, "source")
    # Whole passes and the pass that is cut: a row for each copy of a document that may be emitted.
    last = (F.ceil(F.col("quota") / F.col("total")) - 1).cast("long")
    planned = planned.withColumn("last", last).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(PASSES).cast("long"))))
    planned = planned.withColumn("epoch", F.explode(F.sequence(F.col("first").cast("int"), F.least("last", F.col("first") + (PASSES - 1)).cast("int"))))
    tag = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id")))
    # A document counts as one token at least, so that many texts without words do not share a block.
    blocks = F.ceil(F.greatest("total", "docs") / F.lit(BLOCK_TOKENS)).cast("long")
    planned = planned.withColumn("tag", tag).withColumn("block", F.conv(F.substring("tag", 1, 15), 16, 10).cast("long") % blocks)
    starts = _starts(store.keep(planned.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("n")), "blocks"))
    within = W.partitionBy("source", "epoch", "block").orderBy("tag", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = planned.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = placed.join(starts, ["source", "epoch", "block"]).withColumn("position", F.col("before") + F.col("inside"))
    kept = placed.where(F.col("position") < F.col("quota") - F.col("epoch") * F.col("total"))
    return kept.select(*unboxed(own), *new)
