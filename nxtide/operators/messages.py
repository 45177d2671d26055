"""The message table: order, ranks, scores, whitelists, and what ingestion does to dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODELS = (1, 2, 3, 4)
HOUR = 3600


def running_rank(df: DataFrame, by: tuple, bucket: Column, order: tuple, name: str) -> DataFrame:
    """df with a rank from 0 for each value of `by`, in order; the bucket must come first in that order.

    Rows are ranked within buckets, and a bucket starts at the counts of those before it: no task sorts a whole group.
    Nulls are a group, and a bucket (the first one), of their own: keys are held together in a struct, which is never null.
    """
    keyed = df.withColumn("_at", F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), bucket.alias("bucket")))
    group = [F.col(f"_at.k{i}") for i in range(len(by))]
    before = W.partitionBy(*group).orderBy("_at.bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = keyed.groupBy("_at").count().select("_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_at").orderBy(*order)) - 1 + F.col("_start")
    return keyed.join(starts, "_at").select(*df.columns, rank.alias(name))


def with_first_seen(messages: DataFrame, keys: tuple = ("dn_id",), time: str = "time_s", tie: str = "id") -> DataFrame:
    """Adds rn, rn_qr and rn_qr_rcode: a message's rank for its keys, with is_r, and with is_r and rcode.

    The three partitionings start with the same keys, so one exchange serves all.
    """
    out = messages
    for name, more in (("rn", ()), ("rn_qr", ("is_r",)), ("rn_qr_rcode", ("is_r", "rcode"))):
        out = out.withColumn(name, F.row_number().over(W.partitionBy(*keys, *more).orderBy(time, tie)).cast("long"))
    return out


def with_counters(messages: DataFrame, time: str = "time_s", tie: str = "id") -> DataFrame:
    """Adds fn, a message's place in its capture, and fn_req, the requests before and at it less one (0 at least).

    Messages are ranked within an hour of their capture, which starts at the sums of the hours before it, so that
    no task sorts a whole capture. Those without a time come first in their capture, those without a capture are one; a message
    that is neither a request nor a response counts as no request.
    """
    request = F.coalesce(~F.col("is_r"), F.lit(False))
    keyed = messages.withColumn("_at", F.struct("pcap_id", F.floor(F.col(time) / HOUR).cast("long").alias("hour")))
    hours = keyed.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.count_if(request).alias("_q"))
    before = W.partitionBy("_at.pcap_id").orderBy("_at.hour").rowsBetween(W.unboundedPreceding, -1)
    starts = hours.select("_at", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_q")))
    order = W.partitionBy("_at").orderBy(time, tie)
    running = F.sum(request.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("_q0")
    joined = keyed.join(starts, "_at")
    return joined.select(*messages.columns, (F.row_number().over(order) - 1 + F.col("_n0")).cast("long").alias("fn"), F.greatest(running - 1, F.lit(0)).alias("fn_req"))


def with_translated_time(messages: DataFrame, time: str = "time_s") -> DataFrame:
    """Adds time_s_translated: seconds since the first message of the capture. Only one row of a capture is joined to its messages."""
    first = messages.groupBy("pcap_id").agg(F.min(time).alias("_first")).withColumnRenamed("pcap_id", "_pcap")
    return messages.join(first, F.col("pcap_id").eqNullSafe(F.col("_pcap")), "left").select(*messages.columns, (F.col(time) - F.col("_first")).alias("time_s_translated"))


def scores_by_name(dn_nn: DataFrame, value: str = "value") -> DataFrame:
    """(dn_id, eps1 to eps4): one row for a name, by one pass over the scores instead of a join for each model."""
    return dn_nn.groupBy("dn_id").agg(*(F.max(F.when(F.col("nn_id") == k, F.col(value))).alias(f"eps{k}") for k in MODELS))


def whitelist_ranks(names: DataFrame, whitelist: DataFrame) -> DataFrame:
    """names (dn_id, dn, bdn) with the ranks of both on a whitelist (dn, rank), null where it has none."""
    by = lambda key, rank: whitelist.select(F.col("dn").alias(key), F.col("rank").alias(rank))
    return names.join(by("dn", "rank_dn"), "dn", "left").join(by("bdn", "rank_bdn"), "bdn", "left")


def enriched(messages: DataFrame, names: DataFrame, scores: DataFrame, ranks: DataFrame | None = None, pcap_id: int | None = None, offset: float = 0.0) -> DataFrame:
    """Messages from an offset on, with their names, scores, ranks and first-seen ranks."""
    own = messages.filter(F.col("time_s_translated") >= offset)
    if pcap_id is not None:
        own = own.filter(F.col("pcap_id") == pcap_id)
    out = with_first_seen(own, time="time_s_translated").join(names, "dn_id").join(scores, "dn_id")
    return out if ranks is None else out.join(ranks, "dn_id", "left")


def upsert_names(names: DataFrame, seen: DataFrame) -> DataFrame:
    """names (id, dn) with those of seen (dn) that are new, numbered on from the largest id in the order of their text.

    New names are numbered within buckets of the order, and a bucket starts at the sum of the
    counts before it, so no task sorts all of them.
    """
    new = seen.select("dn").filter("dn is not null").distinct().join(names, "dn", "left_anti")
    last = names.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return names.select("id", "dn").unionByName(numbered(new, "dn").crossJoin(F.broadcast(last)).select((F.col("n") + F.col("last")).alias("id"), "dn"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n from 1 in the order of the bytes of a text column with distinct values; ranked within buckets by their first two bytes."""
    first = F.conv(F.substring(F.rpad(F.hex(F.encode(F.col(order), "utf-8")), 4, "0"), 1, 4), 16, 10).cast("long")
    keyed = df.withColumn("_bucket", first)
    before = keyed.groupBy("_bucket").count().withColumn("_start", F.coalesce(F.sum("count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(order))
    return keyed.withColumn("_rank", rank).join(F.broadcast(before), "_bucket").withColumn("n", F.col("_rank") + F.col("_start")).drop("_bucket", "_rank", "_start")


def filled(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the columns of changes where those have a row for the key and a value."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def dga_ratio(messages: DataFrame, by: tuple = ("pcap_id",)) -> DataFrame:
    """A capture's profile: qr, q, r, u, nx, largest fn_req, and the mean of the shares of NX messages and of names with one."""
    nx = F.col("is_r") & (F.col("rcode") == 3)
    per_name = messages.groupBy(*by, "dn_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_r")).alias("nq"), F.count_if(nx).alias("nnx"), *([F.max("fn_req").alias("last")] if "fn_req" in messages.columns else [])
    )
    out = per_name.groupBy(*by).agg(
        F.sum("n").alias("qr"), F.sum("nq").alias("q"), F.count(F.lit(1)).alias("u"), F.sum("nnx").alias("nx"), F.count_if(F.col("nnx") > 0).alias("unx"), *([F.max("last").alias("fnreq_max")] if "fn_req" in messages.columns else [])
    )
    share = (F.col("nx") / F.col("qr") + F.col("unx") / F.col("u")) / 2
    return out.withColumn("r", F.col("qr") - F.col("q")).withColumn("dga_ratio", share).drop("unx")
