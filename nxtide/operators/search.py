"""Thresholds of log-likelihoods: allocated by how windows lie, tried on training folds, judged on the others. Windows are counted once; no window meets a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Measures that choose a threshold, by the columns tp, fp, tn, fn, and whether more is better.
CHOOSERS = {
    "f1": (lambda tp, fp, tn, fn: F.try_divide(2 * tp, 2 * tp + fp + fn), True),
    "fpr": (lambda tp, fp, tn, fn: F.try_divide(fp, fp + tn), False),
    "tpr": (lambda tp, fp, tn, fn: F.try_divide(tp, tp + fn), True),
    "accuracy": (lambda tp, fp, tn, fn: F.try_divide(tp + tn, tp + fp + tn + fn), True),
}


def whole(llr: Column) -> Column:
    """A log-likelihood as a whole number; thresholds are whole, so that it reaches one if and only if this does."""
    return F.floor(F.round(llr, 6)).cast("long")


def reduced(value: Column, reducer: int) -> Column:
    """A whole log-likelihood cut to a multiple of the reducer, towards zero."""
    return (value - value % reducer).cast("long")


def allocated_thresholds(llrs: DataFrame, blocks: int = 50, most: int = 200, reducer: int = 100) -> DataFrame:
    """(block, k, n, th): thresholds for whole log-likelihoods v, more where there are more of them.

    The range of the reduced values is cut into `blocks` of one width. A block with a share of the values gets that share of `most`
    thresholds, rounded up, an empty one gets one, evenly from its left end; the right end of the last block follows (block `blocks`). So there are
    at most most + 2 * blocks + 1. Where the width does not divide the range, the last block has the rest; a width is 1 at least. Without values there are none.
    """
    if most < 2 * blocks:
        raise ValueError("fewer thresholds than two for each block")
    counts = llrs.filter("v is not null").groupBy(reduced(F.col("v"), reducer).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("v").alias("lo"), (F.max("v") + reducer).alias("hi"), F.sum("n").alias("total")).filter("lo is not null")
    ends = ends.withColumn("step", F.greatest(F.expr(f"(hi - lo) div {blocks}"), F.lit(1)))
    block = F.least(F.expr("(v - lo) div step"), F.lit(blocks - 1)).alias("block")
    held = counts.crossJoin(F.broadcast(ends)).groupBy(block).agg(F.sum("n").alias("n"))  # one row
    spine = ends.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks)).cast("array<bigint>"))).join(held, "block", "left")
    share = F.when(F.col("block") == blocks, 1).when(F.coalesce("n", F.lit(0)) > 0, F.ceil(F.col("n") / F.col("total") * most)).otherwise(1).cast("int")
    spine = spine.withColumn("held", share).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("held") - 1)))
    return spine.select("block", F.col("k").cast("long").alias("k"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.expr("lo + step * block + step div held * k").cast("long").alias("th"))


def histogram(windows: DataFrame, by: tuple) -> DataFrame:
    """(by, v, n): how many windows (by, llr) have each whole log-likelihood. Windows without one are left out of searches."""
    return windows.filter("llr is not null").groupBy(*by, whole(F.col("llr")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def swept(counts: DataFrame, thresholds: list[int], by: tuple) -> DataFrame:
    """(by, j, th, hits, n): how many of the values counted as (by, v, n) reach each threshold, from 0 on.

    Values are first added up between thresholds, and then from the last threshold down: a key has as
    many rows as there are thresholds, whatever its values.
    """
    ths = F.array(*map(F.lit, sorted(set(thresholds)))).cast("array<bigint>")
    at = F.size(F.filter(ths, lambda t: t <= F.col("v")))
    placed = counts.groupBy(*by, at.alias("_at")).agg(F.sum("n").alias("_n"))
    known = counts.groupBy(*by).agg(F.sum("n").alias("n")).withColumn("_key", F.struct(*by))
    spine = known.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size(ths))))
    found = spine.join(placed.select(F.struct(*by).alias("_key"), "_at", "_n"), ["_key", "_at"], "left")
    down = W.partitionBy("_key").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    return found.select(*by, (F.col("_at") - 1).alias("j"), F.element_at(ths, F.col("_at")).alias("th"), F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("hits"), "n")


def threshold_search(windows: DataFrame, thresholds: list[int], parts: int, test: int = 1, reducer: int = 100, choosers: tuple = ("f1", "fpr", "tpr"), by: tuple = ("cfg",)) -> DataFrame:
    """For each configuration, turn and chooser, the best threshold of the training folds and what it does to the others.

    windows: (by, cls, fold from 0 to parts - 1, llr). In turn t the folds t to t + test - 1, round the ring, are judged and the others train.
    Thresholds tried: from the last one at or below the least reduced training value to the last one at or below the largest.
    Class 0 is negative. The best is the first of those with the best measure; a measure that isn't defined is worse than all.
    """
    counts = histogram(windows, (*by, "cls", "fold"))
    turned = counts.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("train", F.pmod(F.col("fold") - F.col("turn"), F.lit(parts)) >= test)
    key = (*by, "turn", "train")
    sums = swept(turned, thresholds, (*key, "cls"))
    good = F.col("cls") == 0
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    hits, rest = F.col("hits"), F.col("n") - F.col("hits")
    table = sums.groupBy(*key, "j", "th").agg(total(~good, hits).alias("tp"), total(good, hits).alias("fp"), total(good, rest).alias("tn"), total(~good, rest).alias("fn"))
    ths = F.array(*map(F.lit, sorted(set(thresholds)))).cast("array<bigint>")
    upto = lambda v: F.size(F.filter(ths, lambda t: t <= v)) - 1
    low, high = reduced(F.min("v"), reducer), reduced(F.max("v"), reducer)
    ranges = turned.filter("train").groupBy(*by, "turn").agg(low.alias("_low"), high.alias("_high"))
    ranges = ranges.select(*by, "turn", F.greatest(upto(F.col("_low")), F.lit(0)).alias("_from"), F.greatest(upto(F.col("_high")), F.lit(0)).alias("_to"))
    cells = ("tp", "fp", "tn", "fn")
    tried = table.filter("train").join(ranges, [*by, "turn"]).filter("j between _from and _to")
    best = []
    for name in choosers:
        measure, greater = CHOOSERS[name]
        score = measure(*(F.col(c) for c in cells))
        rank = F.coalesce((score if greater else -score).cast("double"), F.lit(float("-inf")))
        chosen = F.max_by(F.struct("j", "th", *(F.col(c).alias(f"train_{c}") for c in cells)), F.struct(rank, -F.col("j")))
        best.append(F.struct(F.lit(name).alias("chooser"), chosen.alias("of")))
    found = tried.groupBy(*by, "turn").agg(F.array(*best).alias("b")).select(*by, "turn", F.explode("b").alias("b")).select(*by, "turn", "b.chooser", "b.of.*")
    judged = table.filter("not train").select(*by, "turn", "j", *(F.col(c).alias(f"test_{c}") for c in cells))
    out = found.join(judged, [*by, "turn", "j"], "left")
    scores = lambda side: F.coalesce(*(F.when(F.col("chooser") == name, CHOOSERS[name][0](*(F.col(f"{side}_{c}") for c in cells))) for name in choosers))
    return out.select(*by, "turn", "chooser", "th", *(f"{s}_{c}" for s in ("train", "test") for c in cells), scores("train").alias("train_score"), scores("test").alias("test_score"))


def threshold_table(windows: DataFrame, thresholds: list[int], by: tuple = ("cfg",)) -> DataFrame:
    """(by, cls, th, wrong): the share of a class's windows that each threshold judges wrongly; class 0 is negative."""
    out = swept(histogram(windows, (*by, "cls")), thresholds, (*by, "cls"))
    return out.select(*by, "cls", "th", F.when(F.col("cls") == 0, F.col("hits")).otherwise(F.col("n") - F.col("hits")).alias("n_wrong"), "n").select(*by, "cls", "th", (F.col("n_wrong") / F.col("n")).alias("wrong"))


def threshold_ranges(table: DataFrame, steps: int = 4, by: tuple = ("cfg",)) -> DataFrame:
    """(by, cls, quarter, share): the share of the thresholds at which a class is judged wrongly to that extent, for each of `steps` equal ranges, the last with 1."""
    ths = table.groupBy(*by, "cls").agg(*(F.avg((F.least(F.floor(F.col("wrong") * steps), F.lit(steps - 1)) == q).cast("int")).alias(f"q{q}") for q in range(steps)))
    return ths.unpivot([*by, "cls"], [f"q{q}" for q in range(steps)], "quarter", "share").withColumn("quarter", F.substring("quarter", 2, 9).cast("int"))
