"""The star schema over the supplied tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nxtide.operators.messages import with_counters, with_first_seen, with_translated_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages out of events: a capture is a user's last digit, a name is a user."""
    e = table(spark, sf_dir, "events")
    user, value = F.col("user_id"), F.col("value")
    return e.select(
        F.col("event_id").alias("id"), (user % 10).alias("pcap_id"), user.alias("dn_id"), seconds("ts").alias("time_s"), (~F.col("event_type").isin("view", "click")).alias("is_r"),
        F.when(F.col("event_type") == "error", 3).otherwise(0).alias("rcode"), *((value / (value + 50 * k)).alias(f"eps{k}") for k in (1, 2, 3, 4)), F.when(user % 3 != 0, user).alias("rank_dn"),
    )


def full_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with translated time, counters and first-seen ranks."""
    return with_first_seen(with_counters(with_translated_time(messages(spark, sf_dir))))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages out of lineitem, for what doesn't depend on order: a capture is a supplier, a name is a part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pcap_id"), F.col("l_partkey").alias("dn_id"), seconds("l_shipdate").alias("time_s"), (F.col("l_linestatus") == "F").alias("is_r"),
        F.when(F.col("l_returnflag") == "R", 3).otherwise(0).alias("rcode"), F.col("l_quantity").cast("long").alias("weight"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of part: text, base name, rank."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("dn_id"), F.concat(F.lit("n"), key.cast("string"), F.lit(".b"), (key % 50).cast("string"), F.lit(".com")).alias("dn"), F.concat(F.lit("b"), (key % 50).cast("string"), F.lit(".com")).alias("bdn"), F.when(key % 3 != 0, key).alias("rank_dn"), F.col("p_size").alias("size"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dn_id, nn_id, value): four scores of each name, but for the third model, which lacks every seventh name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dn_id"), "p_size").withColumn("nn_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    return p.filter((F.col("nn_id") != 3) | (F.col("dn_id") % 7 != 0)).select("dn_id", "nn_id", ((F.col("p_size") * F.col("nn_id")) % 50 / F.lit(50.0)).alias("value"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pcap_id, malware_id, dga, name): captures out of supplier, malware out of nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("pcap_id"), F.col("n_nationkey").alias("malware_id"), (F.col("n_regionkey") % 3).alias("dga"), F.col("s_name").alias("name"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, dn): the host of each page's address."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("dn"))


MESSAGES = """m0 AS (SELECT event_id AS id, user_id % 10 AS pcap_id, user_id AS dn_id, epoch_us(ts) / 1e6 AS time_s, event_type NOT IN ('view', 'click') AS is_r,
  CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS rcode, value / (value + 50) AS eps1, value / (value + 100) AS eps2, value / (value + 150) AS eps3, value / (value + 200) AS eps4,
  CASE WHEN user_id % 3 <> 0 THEN user_id END AS rank_dn FROM events)"""
FULL = (
    MESSAGES
    + """, m AS (SELECT *, time_s - min(time_s) OVER (PARTITION BY pcap_id) AS t, row_number() OVER (PARTITION BY pcap_id ORDER BY time_s, id) - 1 AS fn,
  greatest(CAST(sum(CASE WHEN is_r THEN 0 ELSE 1 END) OVER (PARTITION BY pcap_id ORDER BY time_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1, 0) AS fn_req,
  row_number() OVER (PARTITION BY dn_id ORDER BY time_s, id) AS rn, row_number() OVER (PARTITION BY dn_id, is_r ORDER BY time_s, id) AS rn_qr,
  row_number() OVER (PARTITION BY dn_id, is_r, rcode ORDER BY time_s, id) AS rn_qr_rcode FROM m0)"""
)
TRAFFIC = """x AS (SELECT l_suppkey AS pcap_id, l_partkey AS dn_id, epoch_us(l_shipdate) / 1e6 AS time_s, l_linestatus = 'F' AS is_r, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS rcode, CAST(l_quantity AS BIGINT) AS weight FROM lineitem)"""
NAMES = """n AS (SELECT p_partkey AS dn_id, 'n' || p_partkey || '.b' || (p_partkey % 50) || '.com' AS dn, 'b' || (p_partkey % 50) || '.com' AS bdn, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS rank_dn, p_size AS size FROM part)"""
SCORES = """s AS (SELECT p_partkey AS dn_id, nn_id, (p_size * nn_id) % 50 / 50.0 AS value FROM part, (SELECT unnest([1, 2, 3, 4]) AS nn_id) WHERE nn_id <> 3 OR p_partkey % 7 <> 0)"""
CAPTURES = """c AS (SELECT s_suppkey AS pcap_id, n_nationkey AS malware_id, n_regionkey % 3 AS dga, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
HOSTS = r"""h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS dn FROM pages)"""
