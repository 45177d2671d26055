"""Slot pairs: every group of slots of every capture beside healthy traffic, scaled by random multipliers."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_draw(mean: Column, deviation: Column, *by: Column, seed: int = 1) -> Column:
    """A normal value that depends on the seed and the columns alone: the same wherever and whenever a row is computed."""
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *by), 11).cast("double") + 1) / F.lit(float(2**53)) for k in (0, 1)]
    return mean + deviation * F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * pi * u[1])


def slot_pairs(healthy: DataFrame, captures: DataFrame, settings: DataFrame, multipliers: DataFrame | None = None, size: int = 8, starts: int | None = 50, seed: int = 1) -> DataFrame:
    """For each setting, capture and start: what the pairs of `size` slots from the start on and the healthy slots give.

    healthy: (slot, pos), the first `size` count; captures: (pcap_id, slot, pos) without gaps from 0 on; settings: (setting, scale, mean,
    deviation), few. A group begins at each slot that leaves at least one slot after it, up to `starts` of them, as in the study that this follows (None:
    all). Each healthy slot is multiplied by a normal draw for its capture, start and place, rounded up, or by 1 where that is negative or
    the deviation is 0; `multipliers` (setting, pcap_id, start, at, draw) take the place of the draws. The threshold is the largest healthy slot times
    the scale. Slots are dealt out to the groups that hold them, so that the work grows with the slots of all captures.

    fp0, n0: healthy slots over the threshold, and over 0; fp, n: slots where the capture has nothing, and those of them where both together
    are over the threshold; tp, p: the same where it has something; hit: whether any tp.
    """
    base = F.broadcast(healthy.filter(F.col("slot") < size).select(F.col("slot").cast("long").alias("at"), F.col("pos").alias("base")))  # `size` rows
    limits = settings.crossJoin(F.broadcast(healthy.filter(F.col("slot") < size).agg(F.max("pos").alias("most")))).withColumn("th", F.col("most") * F.col("scale"))
    last = captures.groupBy("pcap_id").agg((F.max("slot") - size).alias("last"))
    dealt = captures.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("slot") - size + 1), F.col("slot")).cast("array<bigint>")))
    dealt = dealt if starts is None else dealt.filter(F.col("start") < starts)
    placed = dealt.join(last, "pcap_id").filter(F.col("start") <= F.col("last")).withColumn("at", (F.col("slot") - F.col("start")).cast("long"))
    both = placed.select("pcap_id", "start", "at", "pos").join(base, "at").crossJoin(F.broadcast(limits.select("setting", "th", "mean", "deviation")))
    if multipliers is None:
        both = both.withColumn("draw", normal_draw(F.col("mean"), F.col("deviation"), F.col("setting"), F.col("pcap_id"), F.col("start"), F.col("at"), seed=seed))
    else:
        both = both.join(multipliers, ["setting", "pcap_id", "start", "at"], "left")
    times = F.when((F.col("deviation") <= 0) | F.col("draw").isNull(), 1.0).otherwise(F.when(F.ceil("draw") < 0, 1.0).otherwise(F.ceil("draw").cast("double")))
    scaled = both.withColumn("base", F.col("base") * times)
    over, active = F.col("base") + F.col("pos") > F.col("th"), F.col("pos") > 0
    return scaled.groupBy("setting", "pcap_id", "start").agg(
        F.count_if(F.col("base") > F.col("th")).alias("fp0"), F.count_if(F.col("base") > 0).alias("n0"), F.count_if(~active & over).alias("fp"), F.count_if(~active).alias("n"),
        F.count_if(active & over).alias("tp"), F.count_if(active).alias("p"), F.coalesce(F.bool_or(active & over), F.lit(False)).alias("hit"),
    )


def pair_rates(pairs: DataFrame, by: tuple = ("setting", "pcap_id")) -> DataFrame:
    """Mean, largest and least of the three ratios of slot_pairs(), where they are defined and from 0 to 1, and the sums, by setting and capture."""
    ratio = {"fpr0": F.try_divide("fp0", "n0"), "fpr": F.try_divide("fp", "n"), "tpr": F.try_divide("tp", "p")}
    valid = pairs.withColumns({c: F.when(r.between(0, 1), r) for c, r in ratio.items()})
    stats = [F.avg("fpr0").alias("fpr0_mean"), *(f(c).alias(f"{c}_{n}") for c in ("fpr", "tpr") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min)))]
    return valid.groupBy(*by).agg(
        *stats, F.sum("fp").alias("fp"), F.sum("n").alias("n"), (F.sum("p") - F.sum("tp")).alias("fn"), F.sum("p").alias("p"),
        F.count_if(~F.col("hit")).alias("fn_groups"), F.count(F.lit(1)).alias("groups"), F.avg(F.col("hit").cast("int")).alias("tpr_groups"),
    )
