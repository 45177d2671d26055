"""Structured Streaming forms of the windowed operators. Those with state of their own that wait for late rows are in stateful.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def slot_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None, by: tuple = ()) -> DataFrame:
    """Message counts of each time slot, or of overlapping groups of slots, closed once `late` has passed. stream needs ts, is_r and rcode."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    response = F.col("is_r")
    return stream.withWatermark("ts", late).groupBy(*by, window.alias("slot")).agg(
        F.count(F.lit(1)).alias("qr"), F.count_if(~response).alias("q"), F.count_if(response).alias("r"), F.count_if(response & (F.col("rcode") == 3)).alias("nx")
    )


def sessions(stream: DataFrame, gap: str = "500 milliseconds", late: str = "1 second", by: tuple = ("flow",)) -> DataFrame:
    """Flows that end where nothing comes for the gap: their first and last times and sizes."""
    return stream.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("packets"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def first_seen(stream: DataFrame, keys: tuple = ("dn_id",), late: str | None = None) -> DataFrame:
    """The first message of each key. With `late` state is forgotten after that time, and a key seen again then is first again."""
    if late:
        return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def count_windows(stream: DataFrame, size: int = 50) -> DataFrame:
    """(pcap_id, wnum, qr, q, nx) of each full window of `size` requests of a capture, in order of arrival.

    A window ends before the next window's first request, so the responses after its last
    request belong to it. A capture's state is the counters of its open window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, wnum, qr, q, nx = state.get if state.exists else (0, 0, 0, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable")
        for is_r, rcode in zip(rows["is_r"], rows["rcode"]):
            if not is_r:
                if requests and requests % size == 0 and q:
                    out.append((key[0], wnum, qr, q, nx))
                    wnum, qr, q, nx = wnum + 1, 0, 0, 0
                requests += 1
                q += 1
            qr += 1
            nx += int(bool(is_r) and rcode == 3)
        state.update((requests, wnum, qr, q, nx))
        yield pd.DataFrame(out, columns=["pcap_id", "wnum", "qr", "q", "nx"]).astype("int64")

    counters = "requests long, wnum long, qr long, q long, nx long"
    return stream.groupBy("pcap_id").applyInPandasWithState(step, "pcap_id long, wnum long, qr long, q long, nx long", counters, "append", GroupStateTimeout.NoTimeout)
