"""Windows of a number of requests, grids of parameters, thresholds and detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.functions.packets import NINF, PINF, ZONES, logit, packet_predicate, whitelisted, zone
from nxtide.operators.messages import running_rank

#: Whitelist ranks up to which a name is left out of a log-likelihood sum.
LEVELS = (0, 10, 15, 50)
GRID = {"ninf": "double", "pinf": "double", "wl_rank": "int", "wl_value": "double", "nn": "int", "unique": "boolean", "packet": "string", "nx_inc": "double"}


def count_windows(messages: DataFrame, size: int = 50) -> DataFrame:
    """For each capture and window of `size` requests: its times, names and packet counts. messages need fn_req."""
    per_name = messages.withColumn("wnum", F.expr(f"fn_req div {size}")).groupBy("pcap_id", "wnum", "dn_id")
    parts = per_name.agg(F.count(F.lit(1)).alias("qr"), *(F.count_if(packet_predicate(p)).alias(p) for p in ("q", "r", "nx")), F.min("time_s").alias("t0"), F.max("time_s").alias("t1"), F.min("fn_req").alias("f0"), F.max("fn_req").alias("f1"))
    return parts.groupBy("pcap_id", "wnum").agg(*(F.sum(c).alias(c) for c in ("qr", "q", "r", "nx")), F.count(F.lit(1)).alias("u"), F.min("t0").alias("time_s_start"), F.max("t1").alias("time_s_end"), F.min("f0").alias("fn_req_min"), F.max("f1").alias("fn_req_max"))


def window_profile(messages: DataFrame, models: tuple = (1, 2, 3, 4), size: int = 50) -> DataFrame:
    """For each window: sums of logits by model and whitelist level, names in each zone of a score, infinite logits, listed names.

    Names are counted once in a window. Columns are named llr_<model>_<level>, eps_<model>_<zone>,
    ninf_<model>, pinf_<model> and whitelisted_<level>.
    """
    first = ["rank_dn", *(f"eps{k}" for k in models)]
    names = messages.withColumn("wnum", F.expr(f"fn_req div {size}")).groupBy("pcap_id", "wnum", "dn_id").agg(*(F.max(c).alias(c) for c in first))
    out = [F.count_if(whitelisted(F.col("rank_dn"), n + 1)).alias(f"whitelisted_{n}") for n in LEVELS]
    for k in models:
        e = F.col(f"eps{k}")
        out += [F.count_if(e <= 0).alias(f"ninf_{k}"), F.count_if(e >= 1).alias(f"pinf_{k}")]
        out += [F.count_if(zone(e) == i).alias(f"eps_{k}_{i}") for i in range(len(ZONES) - 1)]
        inside = (e > 0) & (e < 1)
        out += [F.sum(F.when(inside & ~whitelisted(F.col("rank_dn"), n + 1), F.ln(e / (1 - e))).otherwise(0.0)).alias(f"llr_{k}_{n}") for n in LEVELS]
    return names.groupBy("pcap_id", "wnum").agg(*out)


def config_grid(spark: SparkSession, **lists: list) -> DataFrame:
    """The product of lists of parameters, with a number cfg in the order of their values. It is as large as the lists say."""
    frames = [spark.createDataFrame([(v,) for v in values], f"{name} {GRID[name]}").coalesce(1) for name, values in lists.items()]
    grid = reduce(DataFrame.crossJoin, frames)
    return grid.withColumn("cfg", (F.row_number().over(W.orderBy(*lists)) - 1).cast("long"))


def multiplier(unique: Column, packet: Column) -> Column:
    """What a name's logit counts for in a window: once, or once for each message of a packet type."""
    return F.when(unique, F.lit(1)).when(packet == "q", F.col("q")).when(packet == "r", F.col("r")).otherwise(F.col("qr"))


def _by_window(rows: DataFrame) -> DataFrame:
    """rows with all of a window in one partition, so that what is added up by window and parameter isn't shuffled: it is larger than the rows."""
    return rows.repartition("pcap_id", "wnum")


def exact_sum(value: Column) -> Column:
    """The sum of finite doubles, added up as decimals of 18 places: the same in any order, so that windows that hold the same tie at a bound, in any run."""
    return F.sum(value.cast("decimal(38,18)")).cast("double")


def _logit(score: Column) -> Column:
    """The logit of a score between 0 and 1, else null."""
    return F.when((score > 0) & (score < 1), F.ln(score / (1 - score)))


def _summed(met: DataFrame, keys: list[str], more: bool = False) -> DataFrame:
    """(pcap_id, wnum, keys, sums): what configurations with the same keys share.

    met: (pcap_id, wnum, keys, _kind, _times, _logit, _zone, n). A row counts _times for its _logit (kind 3), or for the value that a configuration has for
    listed names (0), scores of 1 or more (1) and of 0 or less (2). With `more`, nx times the key nx_inc is added for each row.
    """
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    kind = F.col("_kind")
    sums = [exact_sum(F.when(kind == 3, F.col("_logit") * F.col("_times"))).alias("_in"), *(F.sum(F.when(kind == i, F.col("_times"))).alias(f"_times_{i}") for i in range(3))]
    sums += [(F.sum(F.when(kind == i, F.col("nx"))) * F.col("nx_inc")).alias(f"_more_{i}") for i in range(4)] if more else []
    bad = [total(F.col("_zone") == z, "_times").alias(f"dn_bad_{z}") for z in range(len(ZONES) - 1)]
    return met.groupBy("pcap_id", "wnum", *keys).agg(*sums, total(kind == 0, "n").alias("listed"), F.sum("n").cast("long").alias("wcount"), *bad)


def _kind(listed: Column, score: Column) -> Column:
    return F.when(listed, 0).when(score >= 1, 1).when(score <= 0, 2).when(score.isNotNull(), 3)


def _configured(sums: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """_summed() under each configuration of the grid, which is small and broadcast. A value that is null leaves its rows out."""
    values = ("wl_value", "pinf", "ninf")
    own = grid.select("cfg", *(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(v).alias(f"_value_{i}") for i, v in enumerate(values)))
    met = sums.join(F.broadcast(own), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)))
    parts = [F.col(f"_value_{i}") * F.col(f"_times_{i}") for i in range(3)] + [F.col("_in")]
    parts = [p + F.col(f"_more_{i}") for i, p in enumerate(parts)] if "_more_0" in sums.columns else parts
    llr = F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)))
    return met.select("pcap_id", "wnum", "cfg", llr.alias("llr"), "listed", "wcount", *(f"dn_bad_{z}" for z in range(len(ZONES) - 1)))


def apply_configs(messages: DataFrame, grid: DataFrame, size: int = 50, model: int = 1) -> DataFrame:
    """(pcap_id, wnum, cfg, llr, listed, wcount, dn_bad_0 to dn_bad_4): each window under each configuration, by its names.

    llr: the log-likelihood sum; listed: names on the whitelist; wcount: names; dn_bad: what counts in each zone of the score.

    Names are added up by window for each of the grid's whitelist lengths and ways to count, and these sums meet the grid, which is
    small and broadcast: it has columns ninf, pinf, wl_rank, wl_value, unique and packet, and may have nx_inc.
    """
    names = messages.withColumn("wnum", F.expr(f"fn_req div {size}")).groupBy("pcap_id", "wnum", "dn_id").agg(
        F.count(F.lit(1)).alias("qr"), *(F.count_if(packet_predicate(p)).alias(p) for p in ("q", "r", "nx")), F.max(f"eps{model}").alias("eps"), F.max("rank_dn").alias("rank")
    )
    keys = ["wl_rank", "unique", "packet", *(["nx_inc"] if "nx_inc" in grid.columns else [])]
    e, more = F.col("eps"), "nx_inc" in keys
    told = _by_window(names).select("*", _logit(e).alias("_logit"), zone(e).alias("_zone"), F.lit(1).alias("n"))
    met = told.crossJoin(F.broadcast(grid.select(*keys).distinct()))
    listed = F.coalesce((F.col("rank") > 0) & (F.col("rank") < F.col("wl_rank")), F.lit(False))
    met = met.withColumns({"_kind": _kind(listed, e), "_times": multiplier(F.col("unique"), F.col("packet"))})
    return _configured(_summed(met, keys, more), grid, keys)


def apply_configs_to_messages(messages: DataFrame, grid: DataFrame, size: int = 50, model: int = 1) -> DataFrame:
    """As apply_configs(), by messages: those of the configuration's packet type count one by one.

    An NX response has nx_inc added to its score (1 at most) before its logit; a whitelisted name counts in the zone of 0. Messages that
    are alike in all that matters are added up first.
    """
    alike = messages.withColumn("wnum", F.expr(f"fn_req div {size}")).groupBy("pcap_id", "wnum", F.col(f"eps{model}").alias("eps"), F.col("rank_dn").alias("rank"), "is_r", (F.col("rcode") == 3).alias("nx")).agg(F.count(F.lit(1)).alias("n"))
    keys = ["wl_rank", "packet", *(["nx_inc"] if "nx_inc" in grid.columns else [])]
    met = _by_window(alike).crossJoin(F.broadcast(grid.select(*keys).distinct()))
    met = met.filter((F.col("packet") == "qr") | ((F.col("packet") == "r") == F.col("is_r")))
    listed = F.coalesce((F.col("rank") > 0) & (F.col("rank") < F.col("wl_rank")), F.lit(False))
    more = F.when(F.col("nx"), F.col("nx_inc")).otherwise(0.0) if "nx_inc" in keys else F.lit(0.0)
    score = F.least(F.col("eps") + more, F.lit(1.0))
    met = met.withColumns({"_listed": listed, "_score": score})
    s, listed = F.col("_score"), F.col("_listed")
    met = met.withColumns({"_kind": _kind(listed, s), "_times": F.col("n"), "_logit": _logit(s), "_zone": zone(F.when(listed, 0.0).otherwise(s))})
    return _configured(_summed(met, keys), grid, keys)


def detect_zones(applied: DataFrame, limits: DataFrame, by: tuple = ("cfg", "cls", "day")) -> DataFrame:
    """(by, zone, dn, llr): for each zone what counted in it by score, and the windows whose log-likelihood lies in it.

    applied: windows under configurations with dn_bad_0 to dn_bad_4, llr and the columns of `by`; limits: thresholds() by cfg.
    A window of a class is added up once, for its day; leave the day out of `by` for all days together.
    """
    met = applied.join(F.broadcast(limits.select("cfg", "lo", "mid", "th", "over")), "cfg").withColumn("_zone", llr_zone(F.col("llr")))
    zones = F.explode(F.array(*(F.struct(F.lit(z).alias("zone"), F.col(f"dn_bad_{z}").cast("long").alias("dn"), (F.col("_zone") == z).cast("long").alias("llr")) for z in range(len(ZONES) - 1))))
    return met.select(*by, zones.alias("z")).groupBy(*by, "z.zone").agg(F.sum("z.dn").alias("dn"), F.sum("z.llr").alias("llr"))


def alarms(zones: DataFrame, value: str = "dn", by: tuple = ("cfg",)) -> DataFrame:
    """(by, false_alarms, true_alarms): what lies in the upper zones, from the middle one on, of class 0 and of the others."""
    upper = F.col("zone") >= (len(ZONES) - 1) // 2
    total = lambda c: F.coalesce(F.sum(F.when(upper & c, F.col(value))), F.lit(0))
    return zones.groupBy(*by).agg(total(F.col("cls") == 0).alias("false_alarms"), total(F.col("cls") > 0).alias("true_alarms"))


def split_by_day(windows: DataFrame, day: int = 0) -> DataFrame:
    """Adds train: windows of class 0 on that day."""
    return windows.withColumn("train", (F.col("cls") == 0) & (F.col("day") == day))


def split_portion(windows: DataFrame, k: int, parts: int, order: tuple = ("pcap_id", "wnum")) -> DataFrame:
    """Adds train: the k-th of `parts` runs of each class, in order; the last run has the remainder. Ranks are made within values of the order's first column."""
    sizes = windows.groupBy("cls").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumnRenamed("cls", "_cls")  # a row for each class, null too
    ranked = running_rank(windows, ("cls",), F.col(order[0]), order, "_place")
    placed = ranked.join(F.broadcast(sizes), ranked["cls"].eqNullSafe(sizes["_cls"]))
    fold = F.least(F.floor(F.col("_place") / F.greatest(F.floor(F.col("_size") / parts), F.lit(1))), F.lit(parts - 1)).cast("long")
    return placed.select(*windows.columns, fold.alias("fold")).withColumn("train", F.col("fold") == k)


def kfold(windows: DataFrame, parts: int, test: int, order: tuple = ("pcap_id", "wnum")) -> DataFrame:
    """A row for each window and turn: in turn t, `test` folds from t on, round the ring, test and the others train."""
    folds = split_portion(windows, 0, parts, order).drop("train")
    turned = folds.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return turned.withColumn("train", F.pmod(F.col("fold") - F.col("turn"), F.lit(parts)) >= test)


def thresholds(train: DataFrame, by: tuple = ("cfg",)) -> DataFrame:
    """The threshold of each configuration: one above the largest log-likelihood of training windows, and bounds of the zones."""
    out = train.groupBy(*by).agg(F.min("llr").alias("lo"), F.max("llr").alias("hi"))
    return out.withColumn("mid", (F.col("lo") + F.col("hi")) / 2).withColumn("th", F.col("hi") + 1).withColumn("over", F.col("hi") + 1 + 0.1 * (F.col("hi") - F.col("lo")))


def detect(windows: DataFrame, limits: DataFrame, by: tuple = ("cfg", "cls")) -> DataFrame:
    """Confusion of windows, and of captures (one with any alarm is positive), by class."""
    judged = windows.join(F.broadcast(limits.select("cfg", "th")), "cfg").withColumn("hit", F.col("llr") >= F.col("th"))
    captures = judged.groupBy(*by, "pcap_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return captures.groupBy(*by).agg(F.sum("hits").alias("wp"), F.sum("misses").alias("wn"), F.count_if(F.col("hits") > 0).alias("sp"), F.count_if(F.col("hits") == 0).alias("sn"))


def llr_zone(value: Column) -> Column:
    """Which of -inf, lo, mid, th, over, +inf a log-likelihood lies between, from 0; needs the columns of thresholds()."""
    return F.when(value < F.col("lo"), 0).when(value < F.col("mid"), 1).when(value < F.col("th"), 2).when(value < F.col("over"), 3).otherwise(4)


def metrics(confusion: DataFrame, beta: float = 1.0, merged: bool = True, by: tuple = ("cfg",)) -> DataFrame:
    """F-beta, false-positive rate and true-positive rates. Class 0 is negative; class 1 counts with 2 or is left out."""
    good = F.col("cls") == 0
    bad = F.col("cls") >= 1 if merged else F.col("cls") == 2
    sums = confusion.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(good, F.col("wp"))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(good, F.col("wn"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(bad, F.col("wp"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(bad, F.col("wn"))), F.lit(0)).alias("fn"),
    )
    weight = beta * beta
    score = F.try_divide((1 + weight) * F.col("tp"), (1 + weight) * F.col("tp") + weight * F.col("fn") + F.col("fp"))
    return sums.withColumn("fbeta", score).withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn"))).withColumn("tpr", F.try_divide("tp", F.col("tp") + F.col("fn")))


def marginals(scores: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """Least, largest and mean value, zeros left out, for each value of each parameter."""
    longer = scores.withColumns({p: F.col(p).cast("string") for p in parameters}).unpivot([value], parameters, "parameter", "setting")
    return longer.filter(F.col(value) != 0).groupBy("parameter", "setting").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def window_logits(messages: DataFrame, size: int = 50, model: int = 1) -> DataFrame:
    """(pcap_id, wnum, llr): the sum of logits of a window's distinct names."""
    names = messages.withColumn("wnum", F.expr(f"fn_req div {size}")).groupBy("pcap_id", "wnum", "dn_id").agg(F.max(f"eps{model}").alias("eps"))
    return names.groupBy("pcap_id", "wnum").agg(exact_sum(logit(F.col("eps"), NINF, PINF)).alias("llr"))


def zone_counts(messages: DataFrame, by: tuple, model: int) -> DataFrame:
    """Messages in each zone of a model's score, as columns named zone_<lower bound>."""
    return messages.groupBy(*by).agg(*(F.count_if(zone(F.col(f"eps{model}")) == i).alias(f"zone_{ZONES[i]}") for i in range(len(ZONES) - 1)))


def over_zones(threshold: float, above: bool) -> Column:
    """The sum of the columns of zone_counts() at or above a threshold that is one of the bounds, or of those below it."""
    chosen = [F.col(f"`zone_{b}`") for b in ZONES[:-1] if (b >= threshold) == above]
    return reduce(lambda a, b: a + b, chosen)
