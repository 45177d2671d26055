"""Queries for slot reports, count windows, detection, suffixes and curves."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.functions.packets import positive
from nxtide.operators import curves, slots, suffixes, windows
from nxtide.operators import messages as msg
from nxtide.operators.scratch import save
from nxtide.plans.registry import query
from nxtide.plans.relational import FILLED, GRID_SQL, HOUR, filled, grid, r6, series
from nxtide.plans.star import CAPTURES, FULL, HOSTS, MESSAGES, NAMES, SCORES, TRAFFIC, captures, full_messages, hosts, messages, names, scores, table, traffic

PACKET_SQL = {"qr": "true", "q": "NOT is_r", "r": "is_r", "nx": "is_r AND rcode = 3", "ok": "is_r AND rcode = 0"}
FIRST_SQL = {"qr": "rn = 1", "q": "rn_qr = 1", "r": "rn_qr = 1", "nx": "rn_qr_rcode = 1", "ok": "rn_qr_rcode = 1"}


def _report_sql(by: str, source: str = "m") -> str:
    parts = [(p, c) for p, c in PACKET_SQL.items()] + [(f"g{p}", f"{c} AND {FIRST_SQL[p]}") for p, c in PACKET_SQL.items()]
    counters = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}, count(*) FILTER (WHERE {c} AND eps1 > 0.5) AS {n}_pos" for n, c in parts)
    return f"SELECT {by} CAST(floor(t / 3600) AS BIGINT) AS slotnum, count(DISTINCT dn_id) AS u, count(DISTINCT pcap_id) AS captures, count(DISTINCT pcap_id) FILTER (WHERE eps1 > 0.5) AS captures_pos, {counters}, round(min(t), 6) AS time_min, round(max(t), 6) AS time_max FROM {source} GROUP BY ALL"


@query(f"WITH {FULL} " + _report_sql(""))
def an12_slot_report(spark, d):
    out = slots.slot_report(full_messages(spark, d))
    return out.withColumns({c: r6(c) for c in ("time_min", "time_max")})


@query(f"WITH {FULL} " + _report_sql("pcap_id,"))
def an13_slot_report_by_capture(spark, d):
    out = slots.slot_report(full_messages(spark, d), by=("pcap_id",))
    return out.withColumns({c: r6(c) for c in ("time_min", "time_max")})


def _names_sql(condition: str, what: str = "dn_id") -> str:
    return f"list_sort(coalesce(list(DISTINCT {what}) FILTER (WHERE {condition}), []))"


@query(
    f"WITH {FULL}, q AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS slotnum, {_names_sql('is_r AND rcode = 3 AND eps1 > 0.5')} AS nx_names, {_names_sql('is_r AND rcode = 3 AND rn_qr_rcode = 1 AND eps1 > 0.5')} AS gnx_names, "
    f"{_names_sql('is_r AND rcode = 3 AND rn_qr_rcode = 1 AND NOT eps1 > 0.5')} AS gnx_neg_names, {_names_sql('true', 'pcap_id')} AS pcaps, {_names_sql('eps1 > 0.5', 'pcap_id')} AS pcaps_pos FROM m GROUP BY ALL) SELECT * FROM q WHERE len(nx_names) > 0"
)
def an12_flagged_names(spark, d):
    out = slots.slot_report(full_messages(spark, d), slots.SlotConfig(sps=86400), names=True)
    return out.select("slotnum", "nx_names", "gnx_names", "gnx_neg_names", "pcaps", "pcaps_pos").filter(F.size("nx_names") > 0)


@query(f"WITH {MESSAGES}, r AS (SELECT *, time_s - 1704500000 AS t FROM m0 WHERE time_s >= 1704500000), k AS (SELECT *, row_number() OVER (PARTITION BY dn_id ORDER BY t, id) AS rn FROM r) SELECT id, rn, rank_dn, round(t, 6) AS t FROM k WHERE pcap_id = 5 ORDER BY id".replace("FROM r)", "FROM r WHERE pcap_id = 5)"))
def udtf_messages_from_offset(spark, d):
    own = messages(spark, d).withColumn("time_s_translated", F.col("time_s") - 1704500000.0).select("id", "pcap_id", "dn_id", "is_r", "rcode", "time_s_translated")
    dims = messages(spark, d).groupBy("dn_id").agg(F.max("rank_dn").alias("rank_dn"))
    out = msg.enriched(own, dims.select("dn_id"), dims.select("dn_id").distinct(), dims, pcap_id=5)
    return out.select("id", "rn", "rank_dn", r6("time_s_translated").alias("t"))


WIN = f"{FULL}, w AS (SELECT pcap_id, fn_req // 50 AS wnum, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r) AS r, count(*) FILTER (WHERE is_r AND rcode = 3) AS nx, count(DISTINCT dn_id) AS u, min(time_s) AS t0, max(time_s) AS t1, min(fn_req) AS fn_req_min, max(fn_req) AS fn_req_max FROM m GROUP BY ALL)"


@query(f"WITH {WIN} SELECT pcap_id, wnum, qr, q, r, nx, u, round(t0, 6) AS time_s_start, round(t1, 6) AS time_s_end, fn_req_min, fn_req_max FROM w")
def stm2_count_windows(spark, d):
    out = windows.count_windows(full_messages(spark, d))
    return out.withColumns({c: r6(c) for c in ("time_s_start", "time_s_end")})


PER_NAME = f"{FULL}, pn AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, max(eps1) AS e, max(rank_dn) AS rank FROM m GROUP BY ALL)"


@query(f"WITH {PER_NAME} SELECT pcap_id, wnum, count(*) FILTER (WHERE rank > 0 AND rank < 51) AS whitelisted_50, count(*) FILTER (WHERE e >= 0.5 AND e < 0.9) AS eps_1_3, round(coalesce(sum(ln(e / (1 - e))) FILTER (WHERE e > 0 AND e < 1), 0), 4) AS llr_1_0, round(coalesce(sum(ln(e / (1 - e))) FILTER (WHERE e > 0 AND e < 1 AND NOT coalesce(rank > 0 AND rank < 51, false)), 0), 4) AS llr_1_50, count(*) FILTER (WHERE e <= 0) AS ninf_1 FROM pn GROUP BY ALL")
def agg27_an2_window_profile(spark, d):
    out = windows.window_profile(full_messages(spark, d), (1,))
    return out.select("pcap_id", "wnum", "whitelisted_50", "eps_1_3", F.round("llr_1_0", 4).alias("llr_1_0"), F.round("llr_1_50", 4).alias("llr_1_50"), "ninf_1")


LLR = f"{PER_NAME}, lr AS (SELECT pcap_id, wnum, pcap_id % 3 AS cls, sum(CASE WHEN e >= 1 THEN 50 WHEN e <= 0 THEN -50 ELSE ln(e / (1 - e)) END) AS llr FROM pn GROUP BY ALL)"


def _llr(spark, d):
    return windows.window_logits(full_messages(spark, d)).withColumn("cls", F.col("pcap_id") % 3)


@query(f"WITH {LLR}, p AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY pcap_id, wnum) - 1 AS rn, count(*) OVER (PARTITION BY cls) AS n FROM lr) SELECT pcap_id, wnum, least(rn // greatest(n // 4, 1), 3) AS fold, least(rn // greatest(n // 4, 1), 3) = 1 AS train FROM p")
def an4_win12_portion_split(spark, d):
    return windows.split_portion(_llr(spark, d), 1, 4).select("pcap_id", "wnum", "fold", "train")


@query(f"WITH {LLR}, p AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY pcap_id, wnum) - 1 AS rn, count(*) OVER (PARTITION BY cls) AS n FROM lr), f AS (SELECT *, least(rn // greatest(n // 4, 1), 3) AS fold FROM p) SELECT pcap_id, wnum, turn, (fold - turn + 4) % 4 >= 1 AS train FROM f, (SELECT unnest(range(0, 4)) AS turn)")
def win13_ring_folds(spark, d):
    return windows.kfold(_llr(spark, d), 4, 1).select("pcap_id", "wnum", F.col("turn").cast("long").alias("turn"), "train")


DETECT = f"{LLR}, z AS (SELECT min(llr) AS lo, max(llr) AS hi FROM lr WHERE cls = 0 AND wnum % 2 = 0), j AS (SELECT lr.*, llr >= hi + 1 - 40 AS hit FROM lr, z)"


def _limits(spark, d):
    train = _llr(spark, d).filter((F.col("cls") == 0) & (F.col("wnum") % 2 == 0)).withColumn("cfg", F.lit(0))
    return windows.thresholds(train)


@query(f"WITH {LLR} SELECT round(min(llr), 4) AS lo, round(max(llr), 4) AS hi, round((min(llr) + max(llr)) / 2, 4) AS mid, round(max(llr) + 1, 4) AS th FROM lr WHERE cls = 0 AND wnum % 2 = 0")
def an5_thresholds(spark, d):
    return _limits(spark, d).select(*(F.round(c, 4).alias(c) for c in ("lo", "hi", "mid", "th")))


@query(f"WITH {DETECT}, s AS (SELECT cls, pcap_id, count(*) FILTER (WHERE hit) AS wp, count(*) FILTER (WHERE NOT hit) AS wn FROM j GROUP BY ALL) SELECT cls, CAST(sum(wp) AS BIGINT) AS wp, CAST(sum(wn) AS BIGINT) AS wn, count(*) FILTER (WHERE wp > 0) AS sp, count(*) FILTER (WHERE wp = 0) AS sn FROM s GROUP BY cls")
def an6_agg29_detection(spark, d):
    low = _limits(spark, d).withColumn("th", F.col("th") - 40)
    return windows.detect(_llr(spark, d).withColumn("cfg", F.lit(0)), low).drop("cfg")


@query(f"WITH {LLR}, z AS (SELECT min(llr) AS lo, max(llr) AS hi FROM lr WHERE cls = 0 AND wnum % 2 = 0) SELECT cls, CASE WHEN llr < lo THEN 0 WHEN llr < (lo + hi) / 2 THEN 1 WHEN llr < hi + 1 THEN 2 WHEN llr < hi + 1 + 0.1 * (hi - lo) THEN 3 ELSE 4 END AS zone, count(*) AS n FROM lr, z GROUP BY ALL")
def an5_llr_zones(spark, d):
    met = _llr(spark, d).crossJoin(F.broadcast(_limits(spark, d)))
    return met.groupBy("cls", windows.llr_zone(F.col("llr")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DETECT}, k AS (SELECT count(*) FILTER (WHERE cls = 0 AND hit) AS fp, count(*) FILTER (WHERE cls = 0 AND NOT hit) AS tn, count(*) FILTER (WHERE cls > 0 AND hit) AS tp, count(*) FILTER (WHERE cls > 0 AND NOT hit) AS fn FROM j) SELECT fp, tn, tp, fn, round(2 * tp / (2 * tp + fn + fp), 6) AS fbeta, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fn), 6) AS tpr FROM k")
def an8_metrics(spark, d):
    low = _limits(spark, d).withColumn("th", F.col("th") - 40)
    found = windows.detect(_llr(spark, d).withColumn("cfg", F.lit(0)), low)
    return windows.metrics(found).drop("cfg").withColumns({c: r6(c) for c in ("fbeta", "fpr", "tpr")})


@query(f"WITH {FULL}, w AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, max(rank_dn) AS rank FROM m GROUP BY ALL), {GRID_SQL}, q AS (SELECT cfg, wl_rank, packet, count(*) FILTER (WHERE rank > 0 AND rank < wl_rank) AS v FROM w, g GROUP BY ALL) SELECT parameter, setting, least, most, round(mean, 6) AS mean, n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS parameter, CAST({c} AS VARCHAR) AS setting, min(v) AS least, max(v) AS most, avg(v) AS mean, count(*) AS n FROM q WHERE v <> 0 GROUP BY {c}" for p, c in (("wl_rank", "wl_rank"), ("packet", "packet"))) + ")")
def agg30_marginals(spark, d):
    """Marginals of the names on the whitelist in the windows of each configuration."""
    listed = windows.apply_configs(full_messages(spark, d), grid(spark)).groupBy("cfg").agg(F.sum("listed").alias("v"))
    scored = grid(spark).join(listed, "cfg")
    return windows.marginals(scored, ["wl_rank", "packet"], "v").withColumn("mean", r6("mean"))


@query(f"WITH {LLR}, q AS (SELECT th, count(*) FILTER (WHERE cls > 0 AND llr >= th) AS tp, count(*) FILTER (WHERE cls > 0 AND llr < th) AS fn, count(*) FILTER (WHERE cls = 0 AND llr >= th) AS fp FROM lr, (SELECT unnest(range(-100, 20, 5)) AS th) GROUP BY th) SELECT th, round(2 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1 FROM q ORDER BY round(2 * tp / nullif(2 * tp + fn + fp, 0), 9) DESC NULLS LAST, th LIMIT 1")
def an10_best_threshold(spark, d):
    ths = F.broadcast(spark.range(-100, 20, 5, 1).withColumnRenamed("id", "th"))
    hit = F.col("llr") >= F.col("th")
    sums = _llr(spark, d).crossJoin(ths).groupBy("th").agg(F.count_if((F.col("cls") > 0) & hit).alias("tp"), F.count_if((F.col("cls") > 0) & ~hit).alias("fn"), F.count_if((F.col("cls") == 0) & hit).alias("fp"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp"))
    return sums.select("th", r6(f1).alias("f1"), F.round(f1, 9).alias("o")).orderBy(F.desc_nulls_last("o"), "th").limit(1).drop("o")


OVERLAP = f"{FILLED}, hb AS (SELECT slot, pp FROM fs WHERE pcap_id = 0 AND slot < 8), th AS (SELECT scale, (SELECT max(pp) FROM hb) * scale AS th FROM (SELECT unnest([CAST(0.5 AS DOUBLE), 1.0]) AS scale)), la AS (SELECT pcap_id, max(slot) - 7 AS last FROM fs WHERE pcap_id > 0 GROUP BY pcap_id), st AS (SELECT pcap_id, unnest(range(0, last + 1)) AS start FROM la), ov AS (SELECT f.pcap_id, scale, start, f.slot - start AS o, pn > 0 AS a, f.pp + hb.pp > th AS p, f.pp + hb.pp AS total, f.pp AS pp FROM st JOIN fs f ON f.pcap_id = st.pcap_id AND f.slot >= start AND f.slot < start + 8 JOIN hb ON hb.slot = f.slot - start, th), oc AS (SELECT pcap_id, scale, start, count(*) FILTER (WHERE p AND a) AS ta, count(*) FILTER (WHERE NOT p AND a) AS ma, count(*) FILTER (WHERE p AND NOT a) AS fa, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, min(CASE WHEN p AND a THEN o + 1 END) AS first_ta, min(CASE WHEN NOT p AND a THEN o + 1 END) AS first_ma, bool_or(a) AS a_day, bool_or(p AND a) AS p_day, min(total) AS least, max(total) AS most, CAST(sum(total) AS BIGINT) AS total, round(avg(pp), 6) AS mean FROM ov GROUP BY ALL)"


def _overlap(spark, d):
    """All captures but the healthy one, number 0, at two thresholds."""
    f = save(filled(spark, d))
    healthy = f.filter("pcap_id = 0").select("slot", F.col("pp").alias("pos"))
    others = f.filter("pcap_id > 0").select("pcap_id", "slot", F.col("pn").alias("activity"), F.col("pp").alias("pos"))
    return slots.overlap_compare(healthy, others, scales=(0.5, 1.0), by=("pcap_id",))


@query(f"WITH {OVERLAP} SELECT * FROM oc")
def an14_overlap(spark, d):
    return _overlap(spark, d).withColumn("mean", r6("mean"))


@query(f"WITH {OVERLAP} SELECT pcap_id % 3 AS malware, scale, CAST(sum(ta) AS BIGINT) AS ta, CAST(sum(ma) AS BIGINT) AS ma, CAST(sum(ta) + sum(ma) AS BIGINT) AS a, round(sum(ta) / nullif(sum(ta) + sum(ma), 0), 6) AS tar, round(1 - count(*) FILTER (WHERE p_day) / nullif(count(*) FILTER (WHERE a_day), 0), 6) AS u_day, round(avg(first_ta), 6) AS mean_first_ta, round(avg(first_ma), 6) AS mean_first_ma, count(*) FILTER (WHERE a_day) AS a_days, count(*) FILTER (WHERE p_day) AS p_days FROM oc GROUP BY ALL")
def an15_an16_overlap_summary(spark, d):
    found = _overlap(spark, d).withColumn("malware", F.col("pcap_id") % 3)
    return slots.overlap_summary(found, ("malware", "scale")).withColumns({c: r6(c) for c in ("tar", "u_day", "mean_first_ta", "mean_first_ma")})


ROC = f"{MESSAGES}, sc AS (SELECT CASE WHEN rcode = 3 THEN 1 ELSE 0 END AS y, round(eps1, 2) AS s FROM m0), rc AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM sc GROUP BY s), pt AS (SELECT s AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM rc WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 1e9, 0, 0), tt AS (SELECT sum(y) AS np, count(*) - sum(y) AS nn FROM sc), ro AS (SELECT threshold, tp, fp, tp / np AS tpr, fp / nn AS fpr FROM pt, tt)"


def _points(spark, d, drop=False):
    scored = messages(spark, d).select((F.col("rcode") == 3).cast("int").alias("y"), F.round("eps1", 2).alias("s"))
    return curves.roc(scored, "y", "s", drop_intermediate=drop)


@query(f"WITH {ROC} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM ro")
def an18_roc(spark, d):
    return _points(spark, d).select(F.when(F.col("threshold") == float("inf"), 1e9).otherwise(F.col("threshold")).alias("threshold"), "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"WITH {ROC} SELECT round((SELECT sum((fpr - x) * (tpr + y) / 2) FROM (SELECT *, lag(fpr) OVER (ORDER BY threshold DESC) AS x, lag(tpr) OVER (ORDER BY threshold DESC) AS y FROM ro)), 6) AS auc, (SELECT threshold FROM ro ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1) AS best")
def an18_auc_and_optimum(spark, d):
    p = save(_points(spark, d))
    best = curves.best_threshold(p).select(F.when(F.col("threshold") == float("inf"), 1e9).otherwise(F.col("threshold")).alias("best"))
    return curves.auc(p).select(r6("auc").alias("auc")).crossJoin(best)


@query(f"WITH {ROC}, l AS (SELECT *, lag(fpr) OVER (ORDER BY threshold DESC) AS x, lag(tpr) OVER (ORDER BY threshold DESC) AS y FROM ro), q AS (SELECT sum(CASE WHEN x > 0.1 THEN 0 ELSE (least(fpr, 0.1) - x) * (y + CASE WHEN fpr = x THEN tpr ELSE y + (tpr - y) * (least(fpr, 0.1) - x) / (fpr - x) END) / 2 END) AS raw FROM l WHERE x IS NOT NULL) SELECT round(raw, 6) AS raw, round(0.5 * (1 + (raw - 0.005) / (0.1 - 0.005)), 6) AS standardised FROM q")
def an19_partial_auc(spark, d):
    return curves.partial_auc(_points(spark, d), 0.1).select(r6("raw").alias("raw"), r6("standardised").alias("standardised"))


@query(f"WITH {MESSAGES} SELECT th, round(avg(CASE WHEN eps1 > th THEN 1.0 ELSE 0.0 END), 6) AS share FROM m0, (SELECT unnest([0.1, 0.25, 0.5, 0.9]) AS th) GROUP BY th".replace("[0.1, 0.25, 0.5, 0.9]", "[CAST(0.1 AS DOUBLE), 0.25, 0.5, 0.9]"))
def an20_detection_shares(spark, d):
    ths = spark.createDataFrame([(t,) for t in (0.1, 0.25, 0.5, 0.9)], "th double")
    return curves.detection_shares(messages(spark, d), "eps1", ths).withColumn("share", r6("share"))


@query(f"WITH {TRAFFIC}, {NAMES}, {CAPTURES} SELECT malware_id, bdn, count(DISTINCT x.pcap_id) AS captures, round(count(*) FILTER (WHERE is_r AND rcode = 3) / count(*), 6) AS nx_share, min(rank_dn) AS rank FROM x JOIN c ON x.pcap_id = c.pcap_id JOIN n ON x.dn_id = n.dn_id GROUP BY ALL")
def an25_malware_names(spark, d):
    # a row for each capture and base name before the second level: no count of distinct values expands rows
    per = traffic(spark, d).groupBy("pcap_id", "dn_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_r") & (F.col("rcode") == 3)).alias("nx"))
    per = per.join(names(spark, d), "dn_id").join(captures(spark, d), "pcap_id").groupBy("malware_id", "bdn", "pcap_id").agg(F.sum("n").alias("n"), F.sum("nx").alias("nx"), F.min("rank_dn").alias("rank"))
    return per.groupBy("malware_id", "bdn").agg(F.count(F.lit(1)).alias("captures"), r6(F.sum("nx") / F.sum("n")).alias("nx_share"), F.min("rank").alias("rank"))


@query(f"WITH {TRAFFIC}, {NAMES}, {SCORES}, {CAPTURES}, k AS (SELECT malware_id, x.dn_id, count(*) AS n, count(*) FILTER (WHERE is_r AND rcode = 3) / count(*) AS nx, max(value) AS e FROM x JOIN c ON x.pcap_id = c.pcap_id JOIN s ON x.dn_id = s.dn_id AND nn_id = 2 GROUP BY ALL) SELECT malware_id, count(*) AS names, count(*) FILTER (WHERE e > 0.5) AS high, count(*) FILTER (WHERE nx > 0.5) AS failing, count(*) FILTER (WHERE e > 0.5 AND nx > 0.5) AS both FROM k GROUP BY malware_id")
def an26_malware_indicators(spark, d):
    s = scores(spark, d).filter("nn_id = 2").select("dn_id", F.col("value").alias("e"))
    k = traffic(spark, d).join(captures(spark, d), "pcap_id").groupBy("malware_id", "dn_id").agg((F.count_if(F.col("is_r") & (F.col("rcode") == 3)) / F.count(F.lit(1))).alias("nx")).join(s, "dn_id")
    high, failing = F.col("e") > 0.5, F.col("nx") > 0.5
    return k.groupBy("malware_id").agg(F.count(F.lit(1)).alias("names"), F.count_if(high).alias("high"), F.count_if(failing).alias("failing"), F.count_if(high & failing).alias("both"))


@query(f"WITH {FULL}, z AS (SELECT CASE WHEN eps1 < 0.1 THEN 0 WHEN eps1 < 0.25 THEN 1 WHEN eps1 < 0.5 THEN 2 WHEN eps1 < 0.9 THEN 3 ELSE 4 END AS zone, count(*) AS n FROM m GROUP BY ALL) SELECT zone, CAST(sum(n) OVER (ORDER BY zone DESC) AS BIGINT) AS fp, round(sum(n) OVER (ORDER BY zone DESC) / ((SELECT max(t) FROM m) / 60), 6) AS per_minute FROM z")
def an27_rate_by_zone(spark, d):
    from nxtide.functions.packets import zone

    m = msg.with_translated_time(messages(spark, d))
    z = m.groupBy(zone(F.col("eps1")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.orderBy(F.desc("zone")).rowsBetween(W.unboundedPreceding, 0))  # one row for a zone
    return z.crossJoin(F.broadcast(m.agg((F.max("time_s_translated") / 60).alias("minutes")))).select("zone", run.alias("fp"), r6(run / F.col("minutes")).alias("per_minute"))


@query(f"WITH {TRAFFIC}, {NAMES}, q AS (SELECT x.dn_id, count(*) FILTER (WHERE is_r AND rcode = 0) AS ok, count(*) FILTER (WHERE is_r AND rcode = 3) AS nx, count(DISTINCT pcap_id) AS captures, list_sort(list(DISTINCT pcap_id)) AS capture_ids FROM x GROUP BY x.dn_id) SELECT q.*, list_contains(capture_ids, 7) AS in7 FROM q JOIN n ON q.dn_id = n.dn_id")
def an30_name_summary(spark, d):
    t = traffic(spark, d).groupBy("dn_id").agg(F.count_if(F.col("is_r") & (F.col("rcode") == 0)).alias("ok"), F.count_if(F.col("is_r") & (F.col("rcode") == 3)).alias("nx"), F.array_sort(F.collect_set("pcap_id")).alias("capture_ids"))
    return t.join(names(spark, d).select("dn_id"), "dn_id").select("dn_id", "ok", "nx", F.size("capture_ids").cast("long").alias("captures"), "capture_ids", F.array_contains("capture_ids", 7).alias("in7"))


SUFFIXES = [("com", "tld"), ("net", "tld"), ("org", "tld"), ("example.com", "icann"), ("example.net", "private"), ("*.example.org", "icann")]


@query(f"WITH {HOSTS}, k AS (SELECT page_id, dn, string_split(dn, '.') AS l FROM h) SELECT page_id, l[-1] AS tld, CASE WHEN len(l) > 2 AND dn LIKE '%.example.com' THEN 'example.com' END AS icann, CASE WHEN len(l) > 2 AND dn LIKE '%.example.net' THEN 'example.net' END AS private, CASE WHEN len(l) > 2 AND (dn LIKE '%.example.com' OR dn LIKE '%.example.net') THEN 2 ELSE 1 END AS rcode, CASE WHEN len(l) > 2 AND (dn LIKE '%.example.com' OR dn LIKE '%.example.net') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS bdn, array_to_string(l[:-2], '.') AS dn_tld FROM k".replace("l[:-2], '.') AS dn_tld", "l[:len(l) - 1], '.') AS dn_tld"))
def joi15_suffix_match(spark, d):
    table_ = spark.createDataFrame(SUFFIXES, "suffix string, group string")
    return suffixes.parse_domains(hosts(spark, d), table_).select("page_id", "tld", "icann", "private", "rcode", "bdn", "dn_tld")


@query("WITH a AS (SELECT n_name AS suffix, CASE WHEN n_nationkey % 2 = 0 THEN 'private' ELSE 'icann' END AS section FROM nation WHERE n_nationkey < 15), b AS (SELECT n_name AS suffix, 'cc' AS type FROM nation WHERE n_nationkey % 3 = 0), c AS (SELECT n_name AS suffix, 'gtld' AS type FROM nation WHERE n_nationkey > 10 AND n_nationkey < 20) SELECT suffix, CASE WHEN len(string_split(suffix, '.')) = 1 THEN 'tld' WHEN section = 'private' THEN 'private' WHEN section IS NOT NULL THEN 'icann' ELSE 'unknown' END AS \"group\", coalesce(p, 0) AS psl, coalesce(t, 0) AS tldlist, coalesce(i, 0) AS iana FROM (SELECT suffix, min(section) AS section, count(*) AS p FROM a GROUP BY suffix) FULL JOIN (SELECT suffix, count(*) AS t FROM b GROUP BY suffix) USING (suffix) FULL JOIN (SELECT suffix, count(*) AS i FROM c GROUP BY suffix) USING (suffix)")
def joi16_suffix_lists(spark, d):
    n = table(spark, d, "nation")
    k, s = F.col("n_nationkey"), F.col("n_name").alias("suffix")
    psl = n.filter(k < 15).select(s, F.when(k % 2 == 0, "private").otherwise("icann").alias("section"))
    out = suffixes.suffix_table(psl, n.filter(k % 3 == 0).select(s, F.lit("cc").alias("type")), n.filter((k > 10) & (k < 20)).select(s, F.lit("gtld").alias("type")))
    return out.select("suffix", "group", "psl", "tldlist", "iana")


@query(f"WITH {FULL} SELECT CAST(floor(t / 3600) AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE eps1 >= 0.5) AS loose, count(*) FILTER (WHERE eps1 > 0.5) AS strict FROM m GROUP BY ALL")
def stm1_time_slots(spark, d):
    m = msg.with_translated_time(messages(spark, d))
    return m.groupBy(slots.slot_of(F.col("time_s_translated"), HOUR).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive(1, 0.5, strict=False)).alias("loose"), F.count_if(positive(1, 0.5)).alias("strict"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts) - INTERVAL (k) HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL")
def stm3_sliding_slots(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "8 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k")
def stm4_sessions(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"))
    return e.select("user_id", "n", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query()
def udf_scored_hosts(spark, d):
    from nxtide.operators.scoring import score

    return score(hosts(spark, d)).select("page_id", r6("value").alias("value"), r6("logit").alias("logit"))


@query()
def an21_monte_carlo(spark, d):
    from nxtide.operators.simulate import monte_carlo

    means = spark.createDataFrame([(m, 2.0, t, 1.0, 14.0) for m in (6.0, 8.0, 10.0) for t in (4.0, 8.0)], "mean_fp double, sd_fp double, mean_tp double, sd_tp double, th double")
    return monte_carlo(means, 50, 1).groupBy("mean_fp", "mean_tp").agg(r6(F.avg("fpr")).alias("fpr"), r6(F.avg("tpr")).alias("tpr"))


@query()
def an23_daily_traffic(spark, d):
    from nxtide.operators.simulate import daily_traffic

    return daily_traffic(spark.range(7).withColumnRenamed("id", "day"), 1)


@query()
def mth5_mth6_distributions(spark, d):
    from nxtide.functions.distributions import negative_binomial_cdf, normal_cdf, normal_quantile

    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return p.select("p_partkey", r6(normal_cdf("x", zero, one)).alias("cdf"), r6(normal_quantile(F.col("x") * 0.98 + 0.01, zero, one)).alias("quantile"), r6(negative_binomial_cdf(F.floor(F.col("x") * 10).cast("double"), F.lit(5.0), F.lit(0.4))).alias("nbinom"))


@query()
def an31_random_split(spark, d):
    train, test = series(spark, d).randomSplit([0.2, 0.8], 7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
