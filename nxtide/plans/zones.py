"""Queries for zones of scores and of log-likelihoods: by configuration, class and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from nxtide.operators import windows
from nxtide.operators.scratch import save
from nxtide.plans.registry import query
from nxtide.plans.relational import GRID_SQL, grid
from nxtide.plans.star import FULL, full_messages

BOUNDS = (0, 0.1, 0.25, 0.5, 0.9, 1.1)
TIMES = "CASE WHEN uniq THEN 1 WHEN packet = 'q' THEN q WHEN packet = 'r' THEN r ELSE qr END"
APPLIED = (
    f"{FULL}, w AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r) AS r, max(eps1) AS e, max(rank_dn) AS rank FROM m GROUP BY ALL), {GRID_SQL}, "
    f"ap AS (SELECT pcap_id, pcap_id % 3 AS cls, pcap_id % 7 AS day, wnum, cfg, sum((CASE WHEN rank > 0 AND rank < wl_rank THEN wl_value WHEN e >= 1 THEN pinf WHEN e <= 0 THEN ninf ELSE ln(e / (1 - e)) END) * ({TIMES})) AS llr, "
    + ", ".join(f"coalesce(sum({TIMES}) FILTER (WHERE e >= {a} AND e < {b}), 0) AS z{i}" for i, (a, b) in enumerate(zip(BOUNDS, BOUNDS[1:])))
    + " FROM w, g GROUP BY pcap_id, wnum, cfg), li AS (SELECT cfg, min(llr) AS lo, max(llr) AS hi FROM ap WHERE cls = 0 GROUP BY cfg), "
    "az AS (SELECT ap.*, CASE WHEN llr < lo THEN 0 WHEN llr < (lo + hi) / 2 THEN 1 WHEN llr < hi + 1 THEN 2 WHEN llr < hi + 1 + 0.1 * (hi - lo) THEN 3 ELSE 4 END AS lz FROM ap JOIN li USING (cfg)), "
    "zo AS (" + " UNION ALL ".join(f"SELECT cfg, cls, day, {i} AS zone, z{i} AS dn, CAST(lz = {i} AS INT) AS llr FROM az" for i in range(5)) + ")"
)


def _applied(spark, d):
    """Windows under each configuration, as a table; a capture's class and day are those of its number.

    They are made once: sums of another run can differ in their last bit, and then a window is not at the bound that it sets itself.
    """
    out = windows.apply_configs(full_messages(spark, d), grid(spark))
    return save(out.select("cfg", (F.col("pcap_id") % 3).alias("cls"), (F.col("pcap_id") % 7).alias("day"), "llr", *(f"dn_bad_{z}" for z in range(5))))


def _zones(spark, d, by):
    applied = _applied(spark, d)
    return windows.detect_zones(applied, windows.thresholds(applied.filter("cls = 0")), by)


@query(f"WITH {APPLIED} SELECT cfg, cls, day, zone, CAST(sum(dn) AS BIGINT) AS dn, CAST(sum(llr) AS BIGINT) AS llr FROM zo GROUP BY ALL")
def agg29_zones_by_day(spark, d):
    return _zones(spark, d, ("cfg", "cls", "day"))


@query(f"WITH {APPLIED} SELECT cfg, CAST(sum(CASE WHEN cls = 0 THEN dn ELSE 0 END) AS BIGINT) AS false_alarms, CAST(sum(CASE WHEN cls > 0 THEN dn ELSE 0 END) AS BIGINT) AS true_alarms FROM zo WHERE zone >= 2 GROUP BY cfg")
def an7_alarms(spark, d):
    return windows.alarms(_zones(spark, d, ("cfg", "cls")))


@query(
    f"WITH {APPLIED} SELECT cfg, cls, round(any_value(lo), 4) AS lo, round(any_value(hi) + 1, 4) AS th, "
    + ", ".join(f"CAST(sum(CASE WHEN zone = {i} THEN dn ELSE 0 END) AS BIGINT) AS dn_{i}, CAST(sum(CASE WHEN zone = {i} THEN zo.llr ELSE 0 END) AS BIGINT) AS llr_{i}" for i in range(5))
    + " FROM zo JOIN li USING (cfg) GROUP BY cfg, cls"
)
def snk15_detection_table(spark, d):
    applied = _applied(spark, d)
    limits = windows.thresholds(applied.filter("cls = 0"))
    wide = windows.detect_zones(applied, limits, ("cfg", "cls")).groupBy("cfg", "cls").pivot("zone", list(range(5))).agg(F.sum("dn").alias("dn"), F.sum("llr").alias("llr"))
    bounds = F.broadcast(limits.select("cfg", F.round("lo", 4).alias("lo"), F.round("th", 4).alias("th")))  # a row for each configuration
    return wide.join(bounds, "cfg").select("cfg", "cls", "lo", "th", *(F.col(f"{i}_{c}").alias(f"{c}_{i}") for i in range(5) for c in ("dn", "llr")))


MESSAGE_TIMES = "packet = 'qr' OR (packet = 'r') = is_r"


@query(
    f"WITH {FULL}, {GRID_SQL}, x AS (SELECT pcap_id, fn_req // 50 AS wnum, cfg, coalesce(rank_dn > 0 AND rank_dn < wl_rank, false) AS listed, least(eps1 + CASE WHEN is_r AND rcode = 3 THEN 0.25 ELSE 0 END, 1) AS e, wl_value, pinf, ninf FROM m, g WHERE {MESSAGE_TIMES}), "
    "y AS (SELECT *, CASE WHEN listed THEN 0 ELSE e END AS v FROM x) SELECT pcap_id, wnum, cfg, round(sum(CASE WHEN listed THEN wl_value WHEN e >= 1 THEN pinf WHEN e <= 0 THEN ninf ELSE ln(e / (1 - e)) END), 4) AS llr, count(*) FILTER (WHERE listed) AS listed, count(*) AS wcount, "
    + ", ".join(f"count(*) FILTER (WHERE v >= {a} AND v < {b}) AS dn_bad_{i}" for i, (a, b) in enumerate(zip(BOUNDS, BOUNDS[1:])))
    + " FROM y GROUP BY pcap_id, wnum, cfg"
)
def agg28_windows_by_message(spark, d):
    m = full_messages(spark, d).withColumn("rcode", F.when(F.col("is_r"), F.col("rcode")))
    return windows.apply_configs_to_messages(m, grid(spark).withColumn("nx_inc", F.lit(0.25))).withColumn("llr", F.round("llr", 4))
