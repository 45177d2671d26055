"""Flows of segments and the ring of recent hashes over whole tables; streaming/stateful.py has them over streams."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.operators.scratch import save
from nxtide.streaming.stateful import WRAP, fresh

#: Microseconds of a bucket of one flow or group, which one task orders.
BUCKET = 3_600_000_000


def with_sessions(segments: DataFrame, gap: int, by: str = "flow", bucket: int = BUCKET) -> DataFrame:
    """segments (by, t) with `session`, the time of the first one since the last lull of more than `gap` microseconds.

    Times are ordered within buckets, which know the last time before them and the last session that began before them: no task orders a
    whole flow. Null flows are one flow; rows without a time have no session.
    """
    keyed = segments.withColumn("_at", F.struct(by, F.floor(F.col("t") / bucket).alias("b")))
    earlier = W.partitionBy("_at." + by).orderBy("_at.b")
    last = keyed.groupBy("_at").agg(F.max("t").alias("_last")).withColumn("_prev", F.lag("_last").over(earlier)).drop("_last")
    within = W.partitionBy("_at").orderBy("t")
    prev = F.coalesce(F.lag("t").over(within), F.col("_prev"))
    flagged = keyed.join(last, "_at").withColumn("_began", F.when(prev.isNull() | (F.col("t") - prev > gap), F.col("t")))
    carried = flagged.groupBy("_at").agg(F.max("_began").alias("_own")).withColumn("_carry", F.last("_own", True).over(earlier.rowsBetween(W.unboundedPreceding, -1))).drop("_own")
    here = F.last("_began", True).over(within.rangeBetween(W.unboundedPreceding, 0))
    return flagged.join(carried, "_at").withColumn("session", F.coalesce(here, "_carry")).drop("_at", "_prev", "_began", "_carry")


def flows(segments: DataFrame, gap: int = 500_000, by: str = "flow", bucket: int = BUCKET) -> DataFrame:
    """(by, packets, first, last, start_seq, bytes, missing, payload) of each flow, as streaming/stateful.py's flows() gives them.

    segments: (by, t in microseconds, seq modulo 2^32, id, data). A flow from lull to lull is ordered in one task, as its
    sequence numbers are unwrapped step by step. Null data is empty.
    """
    told = with_sessions(segments.withColumn("data", F.coalesce("data", F.lit(b""))), gap, by, bucket).withColumn("_of", F.struct(by, "session"))
    arrival = W.partitionBy("_of").orderBy("t", "seq", "id")
    half = WRAP // 2
    step = F.pmod(F.col("seq") - F.lag("seq").over(arrival) + half, F.lit(WRAP)) - half
    placed = told.withColumn("_step", F.coalesce(step, F.lit(0))).withColumn("_first", F.first("seq").over(arrival))
    placed = placed.withColumn("_place", F.sum("_step").over(arrival.rowsBetween(W.unboundedPreceding, 0)))
    size, place = F.octet_length("data").cast("long"), F.col("_place")
    before = W.partitionBy("_of").orderBy("_place", "t", "seq", "id").rowsBetween(W.unboundedPreceding, -1)
    end = F.coalesce(F.max(place + size).over(before), place)
    placed = placed.withColumn("_hole", F.greatest(F.lit(0), place - end)).withColumn("_again", F.greatest(F.lit(0), end - place))
    new = F.when(F.col("_again") < size, F.substring("data", (F.col("_again") + 1).cast("int"), size.cast("int"))).otherwise(F.lit(b""))
    parts = F.array_sort(F.collect_list(F.struct("_place", "t", "seq", "id", new.alias("part"))))
    out = placed.groupBy("_of").agg(
        F.count(F.lit(1)).alias("packets"), F.min("t").alias("first"), F.max("t").alias("last"), F.pmod(F.first("_first") + F.min(place), F.lit(WRAP)).alias("start_seq"),
        F.sum("_hole").alias("missing"), F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["part"])), "")).alias("payload"),
    )
    return out.select(F.col(f"_of.{by}").alias(by), "packets", "first", "last", "start_seq", F.octet_length("payload").cast("long").alias("bytes"), "missing", "payload")


def without_recent(rows: DataFrame, key: Column | str, last: int = 10, by: str = "pcap_id", order: tuple = ("t", "id"), bucket: int = BUCKET) -> DataFrame:
    """rows whose hash isn't among the last `last` distinct ones kept for its group, in order (time in microseconds first): exact, in parallel.

    A group is cut into buckets of time. Each bucket is run from the ring that it is handed, at first an empty one, and
    hands its own on; those that were handed another ring than they were run from are run again, until none is. That ends, as the first
    bucket's ring is right from the start and each round makes one more so; in practice a ring soon forgets how it began. A bucket of a
    group is one task's; rings are `last` hashes a bucket. Null keys are alike, and null groups are one group.
    """
    time, *more = order
    at = F.to_json(F.struct(F.col(by).alias("g"), F.col("_bucket")))
    keyed = save(rows.withColumn("_bucket", F.floor(F.col(time) / bucket)).withColumn("_at", at).withColumn("_hash", F.xxhash64(F.col(key) if isinstance(key, str) else key)))
    slim = keyed.select("_at", *order, "_hash")
    none = F.array().cast("array<bigint>")
    rings = save(keyed.select("_at", F.col(by).alias("_by"), "_bucket").distinct().withColumn("given", none).withColumn("left", F.lit(None).cast("array<bigint>")))
    todo = rings

    def run(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[bool], deque]:
        frame = frame.sort_values(list(order), kind="stable", na_position="first")
        ring = deque(frame["given"].iloc[0])
        return frame, fresh(frame["_hash"].tolist(), ring, last), ring

    def handed(frame: pd.DataFrame) -> pd.DataFrame:
        frame, _, ring = run(frame)
        return pd.DataFrame({"_at": [frame["_at"].iloc[0]], "new": [list(ring)]})

    while True:
        done = slim.join(todo.select("_at", "given"), "_at").groupBy("_at").applyInPandas(handed, "_at string, new array<bigint>")
        merged = rings.join(done, "_at", "left").withColumn("left", F.coalesce("new", "left"))
        before = F.coalesce(F.lag("left").over(W.partitionBy("_by").orderBy("_bucket")), none)
        rings = save(merged.select("_at", "_by", "_bucket", "left", F.col("given").alias("was"), before.alias("given")))
        todo = rings.filter("given <> was")
        if todo.isEmpty():
            break
    names = [c for c in rows.columns]
    numbered = keyed.withColumn("_row", F.monotonically_increasing_id())

    def kept(frame: pd.DataFrame) -> pd.DataFrame:
        frame, mask, _ = run(frame)
        return pd.DataFrame({"_row": frame["_row"][mask]})

    rest = numbered.select("_at", *order, "_hash", "_row").join(rings.select("_at", "given"), "_at").groupBy("_at").applyInPandas(kept, "_row bigint")
    return numbered.join(rest, "_row", "left_semi").select(*names)
