"""Queries for joins, aggregates, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.functions import domains as dom
from nxtide.functions.packets import all_of, logit, packet_predicate, truncated, zone
from nxtide.operators import messages as msg
from nxtide.operators.slots import gap_fill, rolling, slot_of, spine
from nxtide.plans.registry import query
from nxtide.plans.star import CAPTURES, FULL, HOSTS, MESSAGES, NAMES, SCORES, TRAFFIC, captures, full_messages, hosts, messages, names, scores, table, traffic

HOUR = 3600


def r6(c):
    return F.round(c, 6)


# --- projections and filters


@query(f"WITH {FULL} SELECT id, pcap_id, fn, fn_req, fn_req // 50 AS wnum, round(t, 6) AS t FROM m")
def prj2_positional_id(spark: SparkSession, d: str) -> DataFrame:
    return full_messages(spark, d).select("id", "pcap_id", "fn", "fn_req", F.expr("fn_req div 50").alias("wnum"), r6("time_s_translated").alias("t"))


@query("SELECT o_orderkey, coalesce(a, b, c) AS first_set, CASE WHEN v = 0 THEN NULL ELSE v END AS v FROM (SELECT o_orderkey, nullif(o_custkey % 3, 0) AS a, nullif(o_custkey % 5, 0) AS b, o_custkey % 7 AS c, o_custkey % 4 AS v FROM orders)")
def prj4_null_cascade(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    nz = lambda c: F.nullif(c, F.lit(0))
    return o.select("o_orderkey", F.coalesce(nz(k % 3), nz(k % 5), k % 7).alias("first_set"), nz(k % 4).alias("v"))


@query(f"WITH {MESSAGES} SELECT id, dn_id FROM m0 WHERE pcap_id = 3 AND eps1 > 0.5 AND (rank_dn IS NULL OR rank_dn < 100) AND time_s >= 1704067200 AND time_s < 1705000000")
def flt7_optional_predicates(spark, d):
    m = messages(spark, d)
    tests = [F.col("pcap_id") == 3, None, F.col("eps1") > 0.5, F.col("rank_dn").isNull() | (F.col("rank_dn") < 100), (F.col("time_s") >= 1704067200) & (F.col("time_s") < 1705000000)]
    return m.filter(all_of(*tests)).select("id", "dn_id")


@query("SELECT count(*) FILTER (WHERE b IS TRUE) AS t, count(*) FILTER (WHERE b IS FALSE) AS f, count(*) FILTER (WHERE b IS NULL) AS n FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS b FROM orders)")
def flt2_three_valued(spark, d):
    k = F.col("o_custkey") % 3
    b = table(spark, d, "orders").select(F.when(k == 1, True).when(k == 2, False).alias("b"))
    return b.agg(F.count_if(F.col("b").eqNullSafe(True)).alias("t"), F.count_if(F.col("b").eqNullSafe(False)).alias("f"), F.count_if(F.col("b").isNull()).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE list_contains([1, 3, 5], n_nationkey) AND n_regionkey IN (0, 1, 2)")
def flt5_array_contains(spark, d):
    return table(spark, d, "nation").filter(F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("n_nationkey")) & F.col("n_regionkey").isin(0, 1, 2)).select("n_nationkey", "n_name")


@query(f"WITH {FULL} SELECT packet, CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN p AND r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first_seen FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS packet, {c} AS p, {r} AS r FROM m" for p, c, r in (("qr", "true", "rn"), ("q", "NOT is_r", "rn_qr"), ("r", "is_r", "rn_qr"), ("nx", "is_r AND rcode = 3", "rn_qr_rcode"), ("ok", "is_r AND rcode = 0", "rn_qr_rcode"))) + ") GROUP BY packet")
def flt9_packet_predicates(spark, d):
    from nxtide.functions.packets import PACKETS, first_seen_predicate

    sums = full_messages(spark, d).agg(*(F.count_if(packet_predicate(p)).alias(p) for p in PACKETS), *(F.count_if(first_seen_predicate(p)).alias(f"g{p}") for p in PACKETS))
    stack = ", ".join(f"'{p}', {p}, g{p}" for p in PACKETS)
    return sums.select(F.expr(f"stack({len(PACKETS)}, {stack}) as (packet, n, first_seen)"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') ORDER BY c_custkey DESC LIMIT 20 OFFSET 10")
def flt10_search_page(spark, d):
    c = table(spark, d, "customer")
    return c.filter(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).orderBy(F.desc("c_custkey")).offset(10).limit(20).select("c_custkey", "c_name")


# --- joins


@query(f"WITH {TRAFFIC}, {NAMES}, {CAPTURES} SELECT dga, n.bdn, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM x JOIN c ON x.pcap_id = c.pcap_id JOIN n ON x.dn_id = n.dn_id GROUP BY dga, n.bdn")
def joi1_fact_dimensions(spark, d):
    eager = traffic(spark, d).groupBy("pcap_id", "dn_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    return eager.join(captures(spark, d), "pcap_id").join(names(spark, d), "dn_id").groupBy("dga", "bdn").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


@query(f"WITH {NAMES} SELECT a.dn_id, b.rank_dn AS listed FROM n a LEFT JOIN (SELECT * FROM n WHERE dn_id % 2 = 0) b ON a.dn_id = b.dn_id")
def joi2_left_outer(spark, d):
    n = names(spark, d)
    return n.select("dn_id").join(n.filter(F.col("dn_id") % 2 == 0).select("dn_id", F.col("rank_dn").alias("listed")), "dn_id", "left")


@query(f"WITH {SCORES} SELECT s1.dn_id, s1.value AS eps1, s2.value AS eps2, s3.value AS eps3, s4.value AS eps4 FROM (SELECT * FROM s WHERE nn_id = 1) s1 LEFT JOIN (SELECT * FROM s WHERE nn_id = 2) s2 USING (dn_id) LEFT JOIN (SELECT * FROM s WHERE nn_id = 3) s3 USING (dn_id) LEFT JOIN (SELECT * FROM s WHERE nn_id = 4) s4 USING (dn_id)")
def joi3_scores_by_name(spark, d):
    return msg.scores_by_name(scores(spark, d))


@query(f"WITH {NAMES}, {SCORES} SELECT n.dn_id FROM n LEFT JOIN s ON n.dn_id = s.dn_id AND nn_id = 3 WHERE s.dn_id IS NULL")
def joi4_unscored_names(spark, d):
    from nxtide.operators.scoring import unscored

    return unscored(names(spark, d).select("dn_id"), scores(spark, d), 3)


@query(f"WITH {NAMES}, l AS (SELECT bdn AS dn, min(dn_id) AS rank FROM n GROUP BY bdn UNION ALL SELECT dn, dn_id FROM n WHERE dn_id % 4 = 0) SELECT n.dn_id, l1.rank AS rank_dn, l2.rank AS rank_bdn FROM n LEFT JOIN l l1 ON n.dn = l1.dn LEFT JOIN l l2 ON n.bdn = l2.dn")
def joi6_whitelist_ranks(spark, d):
    n = names(spark, d).select("dn_id", "dn", "bdn")
    listed = n.groupBy(F.col("bdn").alias("dn")).agg(F.min("dn_id").alias("rank")).unionByName(n.filter(F.col("dn_id") % 4 == 0).select("dn", F.col("dn_id").alias("rank")))
    return msg.whitelist_ranks(n, listed).select("dn_id", "rank_dn", "rank_bdn")


@query(f"WITH {MESSAGES}, f AS (SELECT pcap_id, min(time_s) AS t0 FROM m0 GROUP BY pcap_id) SELECT id, round(m0.time_s - f.t0, 6) AS t FROM m0 JOIN f ON m0.pcap_id = f.pcap_id")
def joi7_correlated_update(spark, d):
    return msg.with_translated_time(messages(spark, d)).select("id", r6("time_s_translated").alias("t"))


@query(f"WITH {FULL} SELECT (SELECT count(*) FROM m) AS qr, (SELECT count(*) FROM m WHERE NOT is_r) AS q, (SELECT count(*) FROM m WHERE is_r) AS r, (SELECT count(*) FROM m WHERE is_r AND rcode = 3) AS nx, (SELECT count(*) FROM m WHERE rn = 1) AS qr_global")
def joi9_counts_side_by_side(spark, d):
    return full_messages(spark, d).agg(F.count(F.lit(1)).alias("qr"), *(F.count_if(packet_predicate(p)).alias(p) for p in ("q", "r", "nx")), F.count_if(F.col("rn") == 1).alias("qr_global"))


GRID_SQL = "g AS (SELECT *, row_number() OVER (ORDER BY ninf, pinf, wl_rank, wl_value, uniq, packet) - 1 AS cfg FROM (SELECT unnest([-50.0, -20.0]) AS ninf), (SELECT unnest([20.0, 50.0]) AS pinf), (SELECT unnest([10, 50]) AS wl_rank), (SELECT unnest([-50.0, 0.0]) AS wl_value), (SELECT unnest([false, true]) AS uniq), (SELECT unnest(['q', 'qr', 'r']) AS packet))"


def grid(spark: SparkSession) -> DataFrame:
    from nxtide.operators.windows import config_grid

    return config_grid(spark, ninf=[-50.0, -20.0], pinf=[20.0, 50.0], wl_rank=[10, 50], wl_value=[-50.0, 0.0], unique=[False, True], packet=["q", "qr", "r"])


@query(f"WITH {GRID_SQL} SELECT cfg, CAST(ninf AS DOUBLE) AS ninf, CAST(pinf AS DOUBLE) AS pinf, wl_rank, CAST(wl_value AS DOUBLE) AS wl_value, uniq AS is_unique, packet FROM g")
def joi10_config_grid(spark, d):
    return grid(spark).withColumnRenamed("unique", "is_unique")


@query(f"WITH {FULL}, w AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r) AS r, max(eps1) AS e, max(rank_dn) AS rank FROM m GROUP BY ALL), {GRID_SQL} SELECT pcap_id, wnum, cfg, round(sum((CASE WHEN rank > 0 AND rank < wl_rank THEN wl_value WHEN e >= 1 THEN pinf WHEN e <= 0 THEN ninf ELSE ln(e / (1 - e)) END) * (CASE WHEN uniq THEN 1 WHEN packet = 'q' THEN q WHEN packet = 'r' THEN r ELSE qr END)), 4) AS llr, count(*) FILTER (WHERE rank > 0 AND rank < wl_rank) AS listed, count(*) AS wcount, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN uniq THEN 1 WHEN packet = 'q' THEN q WHEN packet = 'r' THEN r ELSE qr END) FILTER (WHERE e >= {a} AND e < {b}), 0) AS BIGINT) AS dn_bad_{z}" for z, a, b in ((0, 0, 0.1), (2, 0.25, 0.5), (4, 0.9, 1.1))) + " FROM w, g GROUP BY pcap_id, wnum, cfg")
def joi11_agg28_windows_by_config(spark, d):
    from nxtide.operators.windows import apply_configs

    return apply_configs(full_messages(spark, d), grid(spark)).select("pcap_id", "wnum", "cfg", F.round("llr", 4).alias("llr"), "listed", "wcount", "dn_bad_0", "dn_bad_2", "dn_bad_4")


SERIES = f"{FULL}, hs AS (SELECT pcap_id, CAST(floor(t / 3600) AS BIGINT) AS slot, count(*) AS pn, count(*) FILTER (WHERE eps1 > 0.3) AS pp FROM m GROUP BY ALL)"


def series(spark: SparkSession, d: str) -> DataFrame:
    m = msg.with_translated_time(messages(spark, d))
    return m.groupBy("pcap_id", slot_of(F.col("time_s_translated"), HOUR).alias("slot")).agg(F.count(F.lit(1)).alias("pn"), F.count_if(F.col("eps1") > 0.3).alias("pp"))


@query(f"WITH {SERIES} SELECT a.slot, a.pn + b.pn AS pn FROM hs a JOIN hs b ON a.slot = b.slot WHERE a.pcap_id = 0 AND b.pcap_id = 1")
def joi13_aligned_sum(spark, d):
    s = series(spark, d)
    other = s.filter("pcap_id = 1").select("slot", F.col("pn").alias("more"))
    return s.filter("pcap_id = 0").join(other, "slot").select("slot", (F.col("pn") + F.col("more")).alias("pn"))


@query(f"WITH {SERIES} SELECT i.slot AS start, count(*) AS n, CAST(sum(s.pn) AS BIGINT) AS pn FROM (SELECT DISTINCT slot FROM hs WHERE pcap_id = 2) i JOIN hs s ON s.slot >= i.slot AND s.slot < i.slot + 8 AND s.pcap_id = 2 GROUP BY i.slot")
def joi14_sliding_alignment(spark, d):
    s = series(spark, d).filter("pcap_id = 2")
    dealt = s.withColumn("start", F.explode(F.sequence(F.col("slot") - 7, F.col("slot"))))
    return dealt.join(s.select(F.col("slot").alias("start")), "start", "left_semi").groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.sum("pn").alias("pn"))


@query("WITH RECURSIVE p(k, up) AS (SELECT r_regionkey + 100, CAST(NULL AS INTEGER) FROM region UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nation), t(k, root, depth) AS (SELECT k, k, 0 FROM p WHERE up IS NULL UNION ALL SELECT p.k, t.root, t.depth + 1 FROM p JOIN t ON p.up = t.k) SELECT root, count(*) AS n, max(depth) AS depth FROM t GROUP BY root")
def joi17_hierarchy(spark, d):
    table(spark, d, "region").createOrReplaceTempView("nx_region")
    table(spark, d, "nation").createOrReplaceTempView("nx_nation")
    return spark.sql("""WITH RECURSIVE p(k, up) AS (SELECT r_regionkey + 100, CAST(NULL AS INT) FROM nx_region UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nx_nation),
      t(k, root, depth) AS (SELECT k, k, 0 FROM p WHERE up IS NULL UNION ALL SELECT p.k, t.root, t.depth + 1 FROM p JOIN t ON p.up = t.k)
      SELECT root, count(*) AS n, max(depth) AS depth FROM t GROUP BY root""")


@query(f"WITH {NAMES}, truth AS (SELECT dn, min(dn_id) AS dac_id FROM n WHERE dn_id % 5 = 0 GROUP BY dn) SELECT n.dn_id, dac_id FROM n LEFT JOIN truth ON n.dn = truth.dn")
def joi18_truth_labels(spark, d):
    n = names(spark, d)
    truth = n.filter(F.col("dn_id") % 5 == 0).groupBy("dn").agg(F.min("dn_id").alias("dac_id"))
    return n.join(truth, "dn", "left").select("dn_id", "dac_id")


# --- aggregates


@query(f"WITH {TRAFFIC} SELECT pcap_id, CAST(floor(time_s / 86400) AS BIGINT) AS slotnum, count(*) AS n, CAST(sum(CASE WHEN NOT is_r THEN 1 ELSE 0 END) AS BIGINT) AS q, CAST(sum(CASE WHEN is_r AND rcode = 3 THEN 1 ELSE 0 END) AS BIGINT) AS nx, CAST(sum(CASE WHEN is_r AND rcode = 3 THEN weight END) AS BIGINT) AS nx_weight FROM x GROUP BY ALL")
def agg3_conditional_sums(spark, d):
    nx = packet_predicate("nx")
    return traffic(spark, d).groupBy("pcap_id", slot_of(F.col("time_s"), 86400).alias("slotnum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(packet_predicate("q")).alias("q"), F.count_if(nx).alias("nx"), F.sum(F.when(nx, F.col("weight"))).alias("nx_weight"))


@query(f"WITH {TRAFFIC}, {NAMES}, {SCORES} SELECT pcap_id, CAST(sum(CASE WHEN rank_dn <= 500 THEN weight ELSE CASE WHEN value <= 0.5 THEN weight ELSE 0 END END) AS BIGINT) AS negative FROM x JOIN n ON x.dn_id = n.dn_id JOIN s ON x.dn_id = s.dn_id AND nn_id = 1 GROUP BY pcap_id")
def agg5_whitelist_override(spark, d):
    s = scores(spark, d).filter("nn_id = 1").select("dn_id", "value")
    joined = traffic(spark, d).groupBy("pcap_id", "dn_id").agg(F.sum("weight").alias("weight")).join(names(spark, d), "dn_id").join(s, "dn_id")
    kept = F.when(F.col("rank_dn") <= 500, F.col("weight")).otherwise(F.when(F.col("value") <= 0.5, F.col("weight")).otherwise(0))
    return joined.groupBy("pcap_id").agg(F.sum(kept).alias("negative"))


@query(f"WITH {TRAFFIC}, {NAMES}, {SCORES} SELECT pcap_id, count(DISTINCT x.dn_id) AS u, count(DISTINCT CASE WHEN value > 0.5 THEN bdn END) AS pos_bdn FROM x JOIN n ON x.dn_id = n.dn_id JOIN s ON x.dn_id = s.dn_id AND nn_id = 1 GROUP BY pcap_id")
def agg7_conditional_distinct(spark, d):
    s = scores(spark, d).filter("nn_id = 1").select("dn_id", "value")
    seen = traffic(spark, d).select("pcap_id", "dn_id").distinct().join(names(spark, d), "dn_id").join(s, "dn_id")
    by_base = seen.groupBy("pcap_id", "bdn").agg(F.count(F.lit(1)).alias("u"), F.bool_or(F.col("value") > 0.5).alias("hit"))
    return by_base.groupBy("pcap_id").agg(F.sum("u").alias("u"), F.count_if("hit").alias("pos_bdn"))


@query(f"WITH {TRAFFIC} SELECT dn_id % 100 AS k, list_sort(list(DISTINCT pcap_id)) AS captures, len(list(weight) FILTER (WHERE rcode = 3)) AS nx FROM x GROUP BY ALL")
def agg8_agg9_lists(spark, d):
    return traffic(spark, d).groupBy((F.col("dn_id") % 100).alias("k")).agg(F.array_sort(F.collect_set("pcap_id")).alias("captures"), F.nullif(F.count_if(F.col("rcode") == 3), F.lit(-1)).alias("nx"))


@query(f"WITH {TRAFFIC}, a AS (SELECT dn_id, CAST(floor(time_s / 2592000) AS BIGINT) AS slot, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT slot, CAST(sum(n) AS BIGINT) AS n, count(*) AS u FROM a GROUP BY slot) SELECT slot % 4 AS quarter, CAST(sum(n) AS BIGINT) AS n, max(u) AS most, min(u) AS least FROM b GROUP BY ALL")
def agg10_three_levels(spark, d):
    a = traffic(spark, d).groupBy("dn_id", slot_of(F.col("time_s"), 2592000).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    b = a.groupBy("slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    return b.groupBy((F.col("slot") % 4).alias("quarter")).agg(F.sum("n").alias("n"), F.max("u").alias("most"), F.min("u").alias("least"))


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 4) AS total, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def agg16_sum_max_mean(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum(q), 4).alias("total"), F.max(q).alias("most"), r6(F.avg(q)).alias("mean"))


@query("SELECT c_mktsegment AS k, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS most FROM customer GROUP BY ALL")
def agg17_describe(spark, d):
    v = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("sd"), F.min(v).alias("least"), *(r6(F.percentile(v, p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)), F.max(v).alias("most"))


@query(f"WITH {CAPTURES} SELECT malware_id, list_sort(list(name)) AS names FROM c GROUP BY malware_id")
def agg18_group_to_list(spark, d):
    return captures(spark, d).groupBy("malware_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def agg20_value_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS flag, count(*) AS repeated FROM (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL")
def agg21_duplicates(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    return table(spark, d, "lineitem").groupBy(*keys).count().filter("count > 1").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("repeated"))


@query(f"WITH {FULL} SELECT pcap_id, round(count(*) FILTER (WHERE eps1 > 0.5) / (max(t) / 60), 6) AS per_minute, round(count(*) FILTER (WHERE is_r AND rcode = 3) / count(*), 6) AS nx_share FROM m GROUP BY ALL")
def agg22_rates(spark, d):
    m = msg.with_translated_time(messages(spark, d))
    return m.groupBy("pcap_id").agg(r6(F.try_divide(F.count_if(F.col("eps1") > 0.5), F.max("time_s_translated") / 60)).alias("per_minute"), r6(F.try_divide(F.count_if(packet_predicate("nx")), F.count(F.lit(1)))).alias("nx_share"))


@query(f"WITH {SERIES} SELECT pcap_id, round(avg(pp) FILTER (WHERE pp > 0), 6) AS mean, round(stddev_samp(pp) FILTER (WHERE pp > 0), 6) AS sd, round(stddev_samp(pp) FILTER (WHERE pp > 0) / avg(pp) FILTER (WHERE pp > 0), 6) AS variation FROM hs GROUP BY pcap_id")
def agg23_masked_variation(spark, d):
    v = F.when(F.col("pp") > 0, F.col("pp"))
    return series(spark, d).groupBy("pcap_id").agg(r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("sd"), r6(F.try_divide(F.stddev_samp(v), F.avg(v))).alias("variation"))


@query(f"WITH {SERIES} SELECT pcap_id, bool_or(pp > 12) AS some, bool_and(pp > 0) AS every, count(*) FILTER (WHERE pp > 12) AS n, min(CASE WHEN pp > 12 THEN slot END) AS first_slot FROM hs GROUP BY pcap_id")
def agg24_agg25_any_all_first(spark, d):
    hit = F.col("pp") > 12
    return series(spark, d).groupBy("pcap_id").agg(F.bool_or(hit).alias("some"), F.bool_and(F.col("pp") > 0).alias("every"), F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("slot"))).alias("first_slot"))


@query(f"WITH {FULL}, k AS (SELECT pcap_id, dn_id, max(CASE WHEN is_r AND rcode = 3 THEN 1 ELSE 0 END) AS nx FROM m GROUP BY ALL) SELECT a.*, round((nx / qr + unx / u) / 2, 6) AS dga_ratio FROM (SELECT pcap_id, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r) AS r, count(*) FILTER (WHERE is_r AND rcode = 3) AS nx, max(fn_req) AS fnreq_max FROM m GROUP BY pcap_id) a JOIN (SELECT pcap_id, count(*) AS u, CAST(sum(nx) AS BIGINT) AS unx FROM k GROUP BY pcap_id) b USING (pcap_id)".replace("a.*,", "pcap_id, qr, q, r, u, nx, fnreq_max,"))
def agg26_capture_profile(spark, d):
    return msg.dga_ratio(full_messages(spark, d)).withColumn("dga_ratio", r6("dga_ratio"))


@query("SELECT grouping(n_regionkey) AS g, n_regionkey AS region, count(*) AS n FROM nation GROUP BY GROUPING SETS ((), (n_regionkey))")
def agg31_grouping_sets(spark, d):
    return table(spark, d, "nation").groupingSets([[], ["n_regionkey"]], "n_regionkey").agg(F.grouping("n_regionkey").cast("long").alias("g"), F.count(F.lit(1)).alias("n")).withColumnRenamed("n_regionkey", "region")


@query(f"WITH {FULL}, v AS (SELECT ln(eps1 / (1 - eps1)) AS l FROM m WHERE eps1 > 0 AND eps1 < 1), b AS (SELECT CAST(floor(l / 0.25) AS BIGINT) AS block, count(*) AS n FROM v GROUP BY ALL) SELECT block, n, CAST(ceil(n / (SELECT sum(n) FROM b) * 200) AS BIGINT) AS thresholds FROM b")
def agg33_logit_histogram(spark, d):
    v = messages(spark, d).filter("eps1 > 0 and eps1 < 1").select(F.floor(logit(F.col("eps1")) / 0.25).alias("block"))
    b = v.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("all")))).select("block", "n", F.ceil(F.col("n") / F.col("all") * 200).alias("thresholds"))


@query("SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY ALL")
def agg37_histogram(spark, d):
    c = table(spark, d, "customer")
    ends = F.broadcast(c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / 30
    return c.crossJoin(ends).groupBy(F.least(F.floor((F.col("c_acctbal") - F.col("lo")) / width), F.lit(29)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SERIES} SELECT slot, CAST(sum(pn) AS BIGINT) AS total, CAST(sum(pp) AS BIGINT) AS pos, CAST(sum(pn) - sum(pp) AS BIGINT) AS neg FROM hs GROUP BY slot")
def agg38_derived_negative(spark, d):
    return series(spark, d).groupBy("slot").agg(F.sum("pn").alias("total"), F.sum("pp").alias("pos")).withColumn("neg", F.col("total") - F.col("pos"))


# --- windows and sequences


@query(f"WITH {FULL} SELECT id, rn, rn_qr, rn_qr_rcode FROM m")
def win2_first_seen_ranks(spark, d):
    return msg.with_first_seen(messages(spark, d)).select("id", "rn", "rn_qr", "rn_qr_rcode")


@query(f"WITH {FULL} SELECT DISTINCT ON (dn_id, pcap_id) dn_id, pcap_id, id FROM m ORDER BY dn_id, pcap_id, time_s, id")
def win3_distinct_on(spark, d):
    return messages(spark, d).groupBy("dn_id", "pcap_id").agg(F.min_by("id", F.struct("time_s", "id")).alias("id"))


FILLED = f"{SERIES}, sp AS (SELECT pcap_id, unnest(range(0, hi + 1)) AS slot FROM (SELECT pcap_id, max(slot) AS hi FROM hs GROUP BY pcap_id)), fs AS (SELECT sp.pcap_id, sp.slot, coalesce(pn, 0) AS pn, coalesce(pp, 0) AS pp FROM sp LEFT JOIN hs ON sp.pcap_id = hs.pcap_id AND sp.slot = hs.slot)"


def filled(spark: SparkSession, d: str) -> DataFrame:
    return gap_fill(series(spark, d), "slot", ("pcap_id",), {"pn": 0, "pp": 0})


@query(f"WITH {FILLED} SELECT pcap_id, slot, CASE WHEN slot >= 7 THEN CAST(sum(pp) OVER w AS BIGINT) END AS sum8, CASE WHEN slot >= 7 THEN max(pp) OVER w END AS max8, CASE WHEN slot >= 7 THEN round(avg(pp) OVER w, 6) END AS mean8 FROM fs WINDOW w AS (PARTITION BY pcap_id ORDER BY slot ROWS 7 PRECEDING)")
def win5_rolling(spark, d):
    out = rolling(filled(spark, d), "slot", 8, {"sum8": F.sum("pp"), "max8": F.max("pp"), "mean8": F.avg("pp")}, ("pcap_id",))
    return out.select("pcap_id", "slot", "sum8", "max8", r6("mean8").alias("mean8"))


@query(f"WITH {FILLED} SELECT pcap_id, slot, coalesce(CASE WHEN count(*) OVER w = 6 THEN CAST(sum(pn) OVER w AS BIGINT) END, 0) AS centred FROM fs WINDOW w AS (PARTITION BY pcap_id ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)")
def win6_centred_rolling(spark, d):
    return rolling(filled(spark, d), "slot", 6, {"centred": F.sum("pn")}, ("pcap_id",), center=True).select("pcap_id", "slot", F.coalesce("centred", F.lit(0)).alias("centred"))


@query(f"WITH {FILLED} SELECT pcap_id, slot, list(pp) OVER (PARTITION BY pcap_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM fs")
def win7_forward_group(spark, d):
    ahead = W.partitionBy("pcap_id").orderBy("slot").rowsBetween(0, 7)
    return filled(spark, d).select("pcap_id", "slot", F.collect_list("pp").over(ahead).alias("ahead"))


@query(f"WITH {FILLED} SELECT pcap_id, slot, CAST(sum(pn) OVER w AS BIGINT) AS running, round(sum(pn) OVER w / sum(pn) OVER (PARTITION BY pcap_id), 6) AS share FROM fs WINDOW w AS (PARTITION BY pcap_id ORDER BY slot ROWS UNBOUNDED PRECEDING)")
def win8_cumulative(spark, d):
    w = W.partitionBy("pcap_id")
    run = F.sum("pn").over(w.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    return filled(spark, d).select("pcap_id", "slot", run.alias("running"), r6(run / F.sum("pn").over(w)).alias("share"))


@query(f"WITH {FILLED} SELECT pcap_id, slot, lag(pn, 1, 0) OVER (PARTITION BY pcap_id ORDER BY slot) AS before FROM fs UNION ALL SELECT pcap_id, max(slot) + 1, max_by(pn, slot) FROM fs GROUP BY pcap_id")
def win9_shift(spark, d):
    f = filled(spark, d)
    shifted = f.select("pcap_id", "slot", F.lag("pn", 1, 0).over(W.partitionBy("pcap_id").orderBy("slot")).alias("before"))
    return shifted.unionByName(f.groupBy("pcap_id").agg((F.max("slot") + 1).alias("slot"), F.max_by("pn", "slot").alias("before")))


@query(f"WITH {FULL} SELECT id, round(min(time_s) OVER (PARTITION BY pcap_id) + sum((coalesce(time_s - p, 0) + 0.5) * 2) OVER (PARTITION BY pcap_id ORDER BY time_s, id ROWS UNBOUNDED PRECEDING), 2) AS v FROM (SELECT *, lag(time_s) OVER (PARTITION BY pcap_id ORDER BY time_s, id) AS p FROM m)")
def win11_an9_retiming(spark, d):
    order = W.partitionBy("pcap_id").orderBy("time_s", "id")
    step = (F.coalesce(F.col("time_s") - F.col("p"), F.lit(0.0)) + 0.5) * 2
    m = messages(spark, d).withColumn("p", F.lag("time_s").over(order))
    total = F.sum(step).over(order.rowsBetween(W.unboundedPreceding, 0))
    return m.select("id", F.round(F.min("time_s").over(W.partitionBy("pcap_id")) + total, 2).alias("v"))


@query(f"WITH {FILLED} SELECT pcap_id, slot, CASE WHEN count(*) OVER w = 5 THEN round((-3 * lag(pn, 2) OVER o + 12 * lag(pn, 1) OVER o + 17 * pn + 12 * lead(pn, 1) OVER o - 3 * lead(pn, 2) OVER o) / 35, 6) END AS smooth FROM fs WINDOW o AS (PARTITION BY pcap_id ORDER BY slot), w AS (PARTITION BY pcap_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def win15_savitzky_golay(spark, d):
    o = W.partitionBy("pcap_id").orderBy("slot")
    # weights of a quadratic over five points
    near = {k: (F.lag("pn", -k) if k < 0 else F.lead("pn", k)).over(o) for k in (-2, -1, 1, 2)} | {0: F.col("pn")}
    taps = sum((w * near[k] for k, w in zip(range(-2, 3), (-3, 12, 17, 12, -3))), F.lit(0))
    return filled(spark, d).select("pcap_id", "slot", r6(taps / 35).alias("smooth"))


# --- sort, limit, sets


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS v FROM orders) ORDER BY v ASC NULLS LAST, o_orderkey DESC LIMIT 100")
def srt1_nulls_last(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("v")).orderBy(F.asc_nulls_last("v"), F.desc("o_orderkey")).limit(100)


@query(f"WITH {MESSAGES} SELECT id, time_s FROM m0 WHERE pcap_id = 4 ORDER BY time_s, id LIMIT 50")
def srt3_first_messages(spark, d):
    return messages(spark, d).filter("pcap_id = 4").select("id", "time_s").orderBy("time_s", "id").limit(50)


@query(f"WITH {SERIES} SELECT pn, pn - lead(pn) OVER (ORDER BY pn DESC) AS gap FROM (SELECT DISTINCT pn FROM hs) ORDER BY pn DESC LIMIT 1")
def srt8_gap_of_top_two(spark, d):
    top = series(spark, d).select("pn").distinct().orderBy(F.desc("pn")).limit(2)
    return top.agg(F.max("pn").alias("pn"), F.nullif(F.max("pn") - F.min("pn"), F.lit(0)).alias("gap"))


@query(f"WITH {SERIES} SELECT slot, " + ", ".join(f"CAST(coalesce(sum(pn) FILTER (WHERE pcap_id = {k}), 0) AS BIGINT) AS c{k}" for k in range(4)) + " FROM hs GROUP BY slot")
def set6_pivot(spark, d):
    wide = series(spark, d).groupBy("slot").pivot("pcap_id", [0, 1, 2, 3]).agg(F.sum("pn"))
    return wide.na.fill(0).select("slot", *(F.col(str(k)).alias(f"c{k}") for k in range(4)))


@query(f"WITH {SERIES} SELECT pcap_id, slot, 'pn' AS metric, pn AS v FROM hs UNION ALL SELECT pcap_id, slot, 'pp', pp FROM hs")
def set7_melt(spark, d):
    return series(spark, d).unpivot(["pcap_id", "slot"], ["pn", "pp"], "metric", "v")


@query(f"WITH {SERIES}, a AS (SELECT pcap_id, list(slot ORDER BY slot) AS s, list(pn ORDER BY slot) AS p FROM hs GROUP BY pcap_id) SELECT pcap_id, unnest(s) AS slot, unnest(p) AS pn FROM a")
def set8_parallel_explode(spark, d):
    a = series(spark, d).groupBy("pcap_id").agg(F.array_sort(F.collect_list(F.struct("slot", "pn"))).alias("l")).select("pcap_id", F.col("l.slot").alias("s"), F.col("l.pn").alias("p"))
    return a.select("pcap_id", F.explode(F.arrays_zip("s", "p")).alias("z")).select("pcap_id", F.col("z.s").alias("slot"), F.col("z.p").alias("pn"))


@query(f"WITH {FILLED} SELECT * FROM fs")
def set9_gap_fill(spark, d):
    return filled(spark, d)


@query(f"WITH {SERIES} SELECT slot, a.pn - coalesce(b.pn, 0) AS diff FROM (SELECT * FROM hs WHERE pcap_id = 0) a LEFT JOIN (SELECT * FROM hs WHERE pcap_id = 1) b USING (slot)")
def set10_frame_difference(spark, d):
    s = series(spark, d)
    return s.filter("pcap_id = 0").join(s.filter("pcap_id = 1").select("slot", F.col("pn").alias("o")), "slot", "left").select("slot", (F.col("pn") - F.coalesce("o", F.lit(0))).alias("diff"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set11_membership(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def set2_concatenation(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def set5_factorize(spark, d):
    c = table(spark, d, "customer")
    codes = c.select("c_mktsegment").distinct().withColumn("code", (F.dense_rank().over(W.orderBy("c_mktsegment")) - 1).cast("long"))
    return c.join(F.broadcast(codes), "c_mktsegment").select("c_custkey", "code")


# --- scalars


LABELS = f"WITH {HOSTS}, p AS (SELECT page_id, dn, string_split(dn, '.') AS l FROM h)"


@query(LABELS + " SELECT page_id, array_to_string(list_reverse(l), '.') AS reversed, len(l) AS labels, array_to_string(l[-2:], '.') AS last_two, array_to_string(l[:-2], '.') AS stem, NOT regexp_matches(dn, '[^a-z0-9.-]') AS plain FROM p")
def str1_labels(spark, d):
    dn = F.col("dn")
    return hosts(spark, d).select("page_id", dom.reversed_labels(dn).alias("reversed"), dom.label_count(dn).cast("long").alias("labels"), dom.last_labels(dn, 2).alias("last_two"), dom.without_suffix(dn, F.substring_index(dn, ".", -1)).alias("stem"), (dom.plain_characters(dn) & dom.is_ascii(dn)).alias("plain"))


@query(LABELS + ", v AS (SELECT *, substr(array_to_string(list_reverse(l), '.'), 1, 60) AS s FROM p) SELECT page_id, list_transform(range(1, 61), lambda i: CASE WHEN i > length(s) THEN 0 ELSE instr('-.0123456789_abcdefghijklmnopqrstuvwxyz', substr(s, i, 1)) END) AS ids FROM v")
def str16_encoder(spark, d):
    return hosts(spark, d).select("page_id", F.transform(dom.encoded(F.col("dn")), lambda x: x.cast("long")).alias("ids"))


@query(r"SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[#0]+', '_', 'g') AS masked, strpos(c_name, '#') AS at FROM customer")
def str11_regular_expressions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), F.regexp_replace("c_name", "[#0]+", "_").alias("masked"), F.instr("c_name", "#").cast("long").alias("at"))


@query("SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, CAST(floor(epoch_us(ts) / 1e6 / 900) AS BIGINT) AS quarter, CAST(extract(hour FROM ts) AS BIGINT) AS h FROM events")
def dat4_slots(spark, d):
    from nxtide.plans.star import seconds

    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), slot_of(seconds("ts"), 900).alias("quarter"), F.hour("ts").cast("long").alias("h"))


@query(f"WITH {MESSAGES} SELECT id, round(ln(eps1 / (1 - eps1)), 6) AS logit, CASE WHEN eps1 < 0.1 THEN 0 WHEN eps1 < 0.25 THEN 1 WHEN eps1 < 0.5 THEN 2 WHEN eps1 < 0.9 THEN 3 ELSE 4 END AS zone, CAST(trunc(floor(ln(eps1 / (1 - eps1)) * 10) / 3) * 3 AS BIGINT) AS reduced FROM m0")
def mth1_logit_zone_reducer(spark, d):
    e = F.col("eps1")
    return messages(spark, d).select("id", r6(logit(e)).alias("logit"), zone(e).alias("zone"), truncated(logit(e) * 10, 3).alias("reduced"))


@query("SELECT c_custkey, CAST(ceil((c_acctbal + 1000) / 500) - 1 AS BIGINT) AS right_closed, CASE WHEN c_acctbal <= q[1] THEN 0 WHEN c_acctbal <= q[2] THEN 1 WHEN c_acctbal <= q[3] THEN 2 ELSE 3 END AS quartile FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)")
def mth4_cuts(spark, d):
    c = table(spark, d, "customer")
    breaks = F.broadcast(c.agg(F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    v = F.col("c_acctbal")
    return c.crossJoin(breaks).select("c_custkey", (F.ceil((v + 1000) / 500) - 1).alias("right_closed"), F.when(v <= F.col("q")[0], 0).when(v <= F.col("q")[1], 1).when(v <= F.col("q")[2], 2).otherwise(3).alias("quartile"))


@query("SELECT n_nationkey, CAST(list_position(['no-malware', 'non-dga', 'dga'], CASE n_regionkey % 3 WHEN 0 THEN 'no-malware' WHEN 1 THEN 'non-dga' ELSE 'dga' END) - 1 AS BIGINT) AS ordinal FROM nation")
def arr1_enum_ordinal(spark, d):
    kinds = F.array(F.lit("no-malware"), F.lit("non-dga"), F.lit("dga"))
    k = F.element_at(kinds, (F.col("n_regionkey") % 3 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", (F.array_position(kinds, k) - 1).alias("ordinal"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn1_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM documents")
def cry1_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"WITH {SERIES}, j AS (SELECT pcap_id, slot, '[' || array_to_string(list_transform(range(0, pp), lambda i: '''n' || i || ''''), ', ') || ']' AS names FROM hs) SELECT pcap_id, slot, CAST(sum(len(from_json(replace(names, '''', '\"'), '[\"VARCHAR\"]'))) OVER (PARTITION BY pcap_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS BIGINT) AS n FROM j")
def arr3_an33_flagged_names(spark, d):
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.when(F.col("pp") > 0, F.sequence(F.lit(0), F.col("pp") - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.concat(F.lit("'n"), i.cast("string"), F.lit("'"))), ", "), F.lit("]"))
    j = series(spark, d).select("pcap_id", "slot", listed.alias("names"))
    parsed = j.withColumn("names", F.from_json(F.regexp_replace("names", "'", '"'), "array<string>"))
    ahead = W.partitionBy("pcap_id").orderBy("slot").rowsBetween(0, 7)
    return parsed.select("pcap_id", "slot", F.size(F.flatten(F.collect_list("names").over(ahead))).cast("long").alias("n"))


# --- changes of tables, as the tables that they leave


@query(f"WITH {NAMES}, old AS (SELECT row_number() OVER (ORDER BY dn) AS id, dn FROM n WHERE dn_id % 2 = 0), new AS (SELECT DISTINCT dn FROM n WHERE dn_id % 3 = 0 AND dn NOT IN (SELECT dn FROM old)) SELECT id, dn FROM old UNION ALL SELECT row_number() OVER (ORDER BY dn) + (SELECT max(id) FROM old), dn FROM new")
def snk4_upsert(spark, d):
    n = names(spark, d)
    old = msg.numbered(n.filter("dn_id % 2 = 0").select("dn"), "dn").select(F.col("n").alias("id"), "dn")
    return msg.upsert_names(old, n.filter("dn_id % 3 = 0"))


@query(f"WITH {NAMES} SELECT dn_id, coalesce(CASE WHEN dn_id % 2 = 0 THEN bdn END, CASE WHEN dn_id % 5 = 0 THEN 'old' END) AS bdn, size FROM n")
def snk5_backfill(spark, d):
    n = names(spark, d)
    stored = n.select("dn_id", F.when(F.col("dn_id") % 5 == 0, "old").alias("bdn"), "size")
    return msg.filled(stored, n.filter("dn_id % 2 = 0"), "dn_id", ["bdn"])


@query(f"WITH {TRAFFIC}, {CAPTURES} SELECT c.pcap_id, dga > 0 AS infected, count(*) AS n FROM x JOIN c ON x.pcap_id = c.pcap_id GROUP BY ALL")
def snk11_marked_partitions(spark, d):
    marked = captures(spark, d).select("pcap_id", (F.col("dga") > 0).alias("infected"))
    return traffic(spark, d).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("n")).join(marked, "pcap_id").select("pcap_id", "infected", "n")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def snk12_resume(spark, d):
    done = table(spark, d, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(done, "n_nationkey", "left_anti")


@query("SELECT t.i AS day, n FROM (SELECT unnest(range(0, 10)) AS i) t LEFT JOIN (SELECT user_id AS i, count(*) AS n FROM events GROUP BY 1) e USING (i)")
def set9_spine(spark, d):
    days = spine(spark.range(1).select(F.lit(0).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi")), "i")
    return days.join(table(spark, d, "events").groupBy(F.col("user_id").alias("i")).agg(F.count(F.lit(1)).alias("n")), "i", "left").select(F.col("i").alias("day"), "n")
