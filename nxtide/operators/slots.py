"""Time slots: reports, filled series, rolling groups, and the overlap of healthy and infected traffic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.functions.packets import PACKETS, first_seen_predicate, packet_predicate, positive


@dataclass(frozen=True)
class SlotConfig:
    """Seconds per slot, model, threshold, and whether a score at the threshold is positive."""

    sps: int = 3600
    nn: int = 1
    th: float = 0.5
    strict: bool = True


def slot_of(time: Column, sps: int) -> Column:
    return F.floor(time / sps).cast("long")


def slot_report(messages: DataFrame, config: SlotConfig = SlotConfig(), by: tuple = (), names: bool = False, time: str = "time_s_translated") -> DataFrame:
    """For each slot: names, the packet types' counts (first-seen ones with a g), and how many of those are positive.

    messages need the ranks of with_first_seen(). All counters are conditional sums of one
    aggregation. captures and captures_pos count the captures with a message and with a positive one. With
    `names`, pcaps and pcaps_pos list them, and of each counter the names behind its positives and, for the
    first-seen ones, behind the others (_neg): distinct and sorted.
    """
    hit = positive(config.nn, config.th, config.strict)
    metrics = [(p, packet_predicate(p)) for p in PACKETS] + [(f"g{p}", first_seen_predicate(p)) for p in PACKETS]
    counters = [F.count_if(c).alias(n) for n, c in metrics] + [F.count_if(c & hit).alias(f"{n}_pos") for n, c in metrics]
    named = [(f"{n}_names", c & hit) for n, c in metrics] + [(f"{n}_neg_names", c & ~hit) for n, c in metrics if n.startswith("g")]
    lists = [F.array_sort(F.collect_set(F.when(c, F.col("dn_id")))).alias(n) for n, c in named if names]
    pcaps = [("captures", "pcaps", F.col("pcap_id")), ("captures_pos", "pcaps_pos", F.when(hit, F.col("pcap_id")))]  # captures are few
    lists += [F.size(F.collect_set(c)).cast("long").alias(n) for n, _, c in pcaps] + [F.array_sort(F.collect_set(c)).alias(n) for _, n, c in pcaps if names]
    return messages.groupBy(*by, slot_of(F.col(time), config.sps).alias("slotnum")).agg(F.countDistinct("dn_id").alias("u"), *counters, *lists, F.min(time).alias("time_min"), F.max(time).alias("time_max"))


def spine(bounds: DataFrame, key: str, lo: str = "lo", hi: str = "hi", inclusive: bool = True) -> DataFrame:
    """A row for each whole number from lo to hi of each row of bounds."""
    end = F.col(hi) - (0 if inclusive else 1)
    return bounds.filter(end >= F.col(lo)).withColumn(key, F.explode(F.sequence(F.col(lo), end))).drop(lo, hi)


def gap_fill(df: DataFrame, key: str, by: tuple = (), fill: dict | None = None, lo: int | None = 0, inclusive: bool = True) -> DataFrame:
    """df with a row for each value of key from lo (or the least) to the largest, those added with the values of fill."""
    bounds = df.groupBy(*by).agg((F.lit(lo).cast("long") if lo is not None else F.min(key)).alias("lo"), F.max(key).alias("hi"))
    return spine(bounds, key, inclusive=inclusive).join(df, [*by, key], "left").na.fill(fill or {})


def rolling(df: DataFrame, order: str, size: int, aggregates: dict[str, Column], by: tuple = (), min_periods: int | None = None, center: bool = False) -> DataFrame:
    """Adds aggregates over a window of `size` rows, null where it has fewer than min_periods (size, if not given)."""
    frame = (-(size // 2), (size - 1) // 2) if center else (1 - size, 0)
    over = W.partitionBy(*by).orderBy(order).rowsBetween(*frame)
    enough = F.count(F.lit(1)).over(over) >= (size if min_periods is None else min_periods)
    return df.withColumns({name: F.when(enough, a.over(over)) for name, a in aggregates.items()})


def overlap_compare(healthy: DataFrame, capture: DataFrame, size: int = 8, step: int = 1, scales: tuple = (1.0,), by: tuple = ()) -> DataFrame:
    """Compares captures' groups of `size` slots, from every step-th slot on, with the first slots of healthy traffic.

    healthy: (slot, pos); capture: (by, slot, activity, pos), any number of captures at once. A threshold is the
    largest healthy count times one of the scales. Each slot is dealt out to the groups that it is in, at most `size`
    of them, instead of a range join. Returns for each capture, scale and start ta, ma, fa, tn (they add up to size), the first
    true and missed alarms from 1 on, the day's verdict, least, largest and summed counts of both together, and the capture's mean.
    """
    base = healthy.filter(F.col("slot") < size).select(F.col("slot").alias("at"), F.col("pos").alias("base"))
    scaled = F.explode(F.array(*map(F.lit, scales)))
    threshold = base.agg(F.max("base").alias("most")).withColumn("scale", scaled).select("scale", (F.col("most") * F.col("scale")).alias("th"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("slot") - size + 1), F.col("slot"))
    groups = capture.withColumn("start", F.explode(starts)).filter(F.col("start") % step == 0).withColumn("at", F.col("slot") - F.col("start"))
    last = capture.groupBy(*by).agg((F.max("slot") - size + 1).alias("last"))
    placed = (groups.join(last, list(by)) if by else groups.crossJoin(F.broadcast(last))).filter(F.col("start") <= F.col("last"))
    both = placed.join(F.broadcast(base), "at").crossJoin(F.broadcast(threshold))  # `size` rows, and one for each scale
    total = F.col("pos") + F.col("base")
    marked = both.withColumn("p", total > F.col("th")).withColumn("a", F.col("activity") > 0)
    ordinal = F.col("at") + 1
    return marked.groupBy(*by, "scale", "start").agg(
        F.count_if(F.col("p") & F.col("a")).alias("ta"),
        F.count_if(~F.col("p") & F.col("a")).alias("ma"),
        F.count_if(F.col("p") & ~F.col("a")).alias("fa"),
        F.count_if(~F.col("p") & ~F.col("a")).alias("tn"),
        F.min(F.when(F.col("p") & F.col("a"), ordinal)).alias("first_ta"),
        F.min(F.when(~F.col("p") & F.col("a"), ordinal)).alias("first_ma"),
        F.bool_or("a").alias("a_day"),
        F.bool_or(F.col("p") & F.col("a")).alias("p_day"),
        F.min(total).alias("least"),
        F.max(total).alias("most"),
        F.sum(total).alias("total"),
        F.avg("pos").alias("mean"),
    )


def overlap_summary(compared: DataFrame, by: tuple = ()) -> DataFrame:
    """Sums of an overlap's groups, the share of active ones that no alarm found, and the mean first alarms; by malware and scale for a table of both."""
    return compared.groupBy(*by).agg(
        F.sum("ta").alias("ta"), F.sum("ma").alias("ma"), (F.sum("ta") + F.sum("ma")).alias("a"),
        F.try_divide(F.sum("ta"), F.sum("ta") + F.sum("ma")).alias("tar"),
        (1 - F.try_divide(F.count_if("p_day"), F.count_if("a_day"))).alias("u_day"),
        F.avg("first_ta").alias("mean_first_ta"),
        F.avg("first_ma").alias("mean_first_ma"),
        F.count_if("a_day").alias("a_days"),
        F.count_if("p_day").alias("p_days"),
    )
