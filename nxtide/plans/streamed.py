"""Queries over flows, rings and windows with late rows, as batches and through streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.operators import flows
from nxtide.operators.scratch import new_path
from nxtide.plans.registry import query
from nxtide.plans.star import MESSAGES, table
from nxtide.streaming import stateful

#: Microseconds of the lull after which a flow ends, and of the wait for late rows.
LULL, WAIT = 7_200_000_000, 600_000_000
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def segments(events: DataFrame) -> DataFrame:
    """Segments out of events: a flow is a twentieth of the users; sequence numbers go on with time, overlap, leave holes and wrap around."""
    t = F.expr(MICROS)
    seq = F.pmod(F.lit(4_294_960_000) + F.floor((t - 1_704_067_200_000_000) / 600_000_000) * 16 + F.col("event_id") % 5, F.lit(stateful.WRAP))
    data = F.encode(F.concat("event_type", F.col("event_id").cast("string")), "utf-8")
    return events.select((F.col("user_id") % 20).alias("flow"), t.alias("t"), seq.cast("long").alias("seq"), F.col("event_id").alias("id"), data.alias("data"))


def messages(events: DataFrame) -> DataFrame:
    """Messages as plans/star.py has them, with t in microseconds."""
    return events.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("pcap_id"), F.col("user_id").alias("dn_id"), F.expr(MICROS).alias("t"),
        (~F.col("event_type").isin("view", "click")).alias("is_r"), F.when(F.col("event_type") == "error", 3).otherwise(0).alias("rcode"),
    )


def through_stream(spark, d: str, make) -> DataFrame:
    """What make(stream of events, with a time ts) gives until all of the table is read, by way of files in the shared folder."""
    path = new_path(spark)
    before = {k: spark.conf.get(k, None) for k in stateful.STORE}
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    try:
        table(spark, d, "events").write.mode("append").parquet(f"{path}/in")  # a stream reads folders, the table may be a file
        stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/in")
        out = make(stream)
        run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


FLOWS = f"""s AS (SELECT user_id % 20 AS flow, epoch_us(ts) AS t, (4294960000 + (epoch_us(ts) - 1704067200000000) // 600000000 * 16 + event_id % 5) % 4294967296 AS seq, event_id AS id,
  event_type || event_id AS data FROM events),
b AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY flow ORDER BY t, seq, id), {LULL + 1}) > {LULL} THEN t END AS began FROM s),
f AS (SELECT *, last_value(began IGNORE NULLS) OVER (PARTITION BY flow ORDER BY t, seq, id ROWS UNBOUNDED PRECEDING) AS session FROM b),
g AS (SELECT *, coalesce((seq - lag(seq) OVER w + 2147483648 + 4294967296) % 4294967296 - 2147483648, 0) AS step, first_value(seq) OVER w AS seq0 FROM f WINDOW w AS (PARTITION BY flow, session ORDER BY t, seq, id)),
h AS (SELECT *, sum(step) OVER (PARTITION BY flow, session ORDER BY t, seq, id ROWS UNBOUNDED PRECEDING) AS place FROM g),
i AS (SELECT *, coalesce(max(place + strlen(data)) OVER (PARTITION BY flow, session ORDER BY place, t, seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), place) AS reach FROM h),
j AS (SELECT flow, session, count(*) AS packets, min(t) AS first, max(t) AS last, CAST((any_value(seq0) + min(place) + 4294967296) % 4294967296 AS BIGINT) AS start_seq,
  CAST(sum(greatest(0, place - reach)) AS BIGINT) AS missing, string_agg(substr(data, CAST(greatest(0, reach - place) + 1 AS BIGINT)), '' ORDER BY place, t, seq, id) AS payload FROM i GROUP BY flow, session)"""
FLOW_COLUMNS = "SELECT flow, packets, first, last, start_seq, strlen(payload) AS bytes, missing, sha256(payload) AS payload_sha256 FROM j"


def shown(found: DataFrame) -> DataFrame:
    return found.select("flow", "packets", "first", "last", "start_seq", "bytes", "missing", F.sha2("payload", 256).alias("payload_sha256"))


@query(f"WITH {FLOWS} {FLOW_COLUMNS}")
def stm4_stm8_flows(spark, d):
    return shown(flows.flows(segments(table(spark, d, "events")), LULL))


@query(f"WITH {FLOWS}, wm AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - {WAIT} AS wm FROM events) {FLOW_COLUMNS}, wm WHERE last + {LULL} < wm")
def stm8_flows_of_a_stream(spark, d):
    """Flows that a stream of the table has closed by its last watermark."""
    return shown(through_stream(spark, d, lambda e: stateful.flows(segments(e).withColumn("ts", F.timestamp_micros("t")), LULL, "10 minutes")).filter("not late"))


@query(f"""WITH {MESSAGES}, r AS (SELECT *, CAST(round(time_s * 1e6) AS BIGINT) AS t, CAST(sum(CASE WHEN is_r THEN 0 ELSE 1 END) OVER (PARTITION BY pcap_id ORDER BY time_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS req FROM m0),
w AS (SELECT pcap_id, CASE WHEN req = 0 THEN 0 ELSE (req - 1) // 20 END AS wnum, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r AND rcode = 3) AS nx, min(t) FILTER (WHERE NOT is_r) AS t FROM r GROUP BY ALL)
SELECT w.pcap_id, w.wnum, w.qr, w.q, w.nx FROM w JOIN w next ON next.pcap_id = w.pcap_id AND next.wnum = w.wnum + 1 WHERE next.t < (SELECT epoch_us(max(ts)) // 1000 * 1000 - {WAIT} FROM events)""")
def stm7_windows_of_a_stream(spark, d):
    """Windows that a stream of the table has filled by its last watermark; nothing of a single batch is late."""
    found = through_stream(spark, d, lambda e: stateful.count_windows(messages(e).withColumn("ts", F.timestamp_micros("t")).drop("t"), 20))
    return stateful.split(found)[0]


@query()
def stm5_recent_hashes(spark, d):
    """Messages that are not among the last ten distinct names of their capture."""
    return flows.without_recent(messages(table(spark, d, "events")), "dn_id").select("id", "pcap_id", "dn_id", "t")
