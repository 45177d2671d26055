"""Further queries, one for each operator that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nxtide.functions import domains as dom
from nxtide.functions.packets import packet_predicate
from nxtide.operators import messages as msg
from nxtide.operators import service, windows
from nxtide.operators.slots import slot_of
from nxtide.plans.detection import FIRST_SQL, LLR, PACKET_SQL, _llr
from nxtide.plans.registry import query
from nxtide.plans.relational import SERIES, r6, series
from nxtide.plans.star import CAPTURES, FULL, HOSTS, MESSAGES, NAMES, SCORES, TRAFFIC, captures, full_messages, hosts, messages, names, scores, seconds, table, traffic


@query("SELECT o_orderkey, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END AS v FROM orders)")
def prj3_nan_to_null(spark, d):
    v = F.when(F.col("o_custkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@query(f"WITH {CAPTURES} SELECT pcap_id, dga, name FROM c WHERE dga <> 1")
def prj1_flt1_captures(spark, d):
    return captures(spark, d).filter(F.col("dga") != 1).select("pcap_id", "dga", "name")


@query(f"WITH {NAMES} SELECT dn_id, bdn FROM n WHERE rank_dn IS NULL AND size BETWEEN 10 AND 20")
def flt6_flt11_null_and_range(spark, d):
    return names(spark, d).filter(F.col("rank_dn").isNull() & F.col("size").between(10, 20)).select("dn_id", "bdn")


@query(f"WITH {SERIES}, a AS (SELECT slot, CAST(sum(pn) AS BIGINT) AS n FROM hs GROUP BY slot) SELECT slot, n FROM a WHERE slot >= 10 AND n > 5")
def flt8_filter_after_aggregate(spark, d):
    return series(spark, d).groupBy("slot").agg(F.sum("pn").alias("n")).filter((F.col("slot") >= 10) & (F.col("n") > 5))


@query(f"WITH {NAMES}, {SCORES} SELECT n.dn_id, s.value FROM n LEFT JOIN s ON n.dn_id = s.dn_id AND s.nn_id = 3")
def joi5_extra_condition(spark, d):
    return names(spark, d).select("dn_id").join(scores(spark, d).filter("nn_id = 3").select("dn_id", "value"), "dn_id", "left")


@query(f"WITH {TRAFFIC}, {SCORES} SELECT x.pcap_id, round(sum(CAST(round(s.value * 50) AS BIGINT)) / (50.0 * count(*)), 6) AS mean FROM x JOIN s ON x.dn_id = s.dn_id AND s.nn_id = 2 GROUP BY x.pcap_id")
def joi8_scores_to_messages(spark, d):
    counted = traffic(spark, d).groupBy("pcap_id", "dn_id").agg(F.count(F.lit(1)).alias("n"))
    s = scores(spark, d).filter("nn_id = 2").select("dn_id", F.round(F.col("value") * 50).cast("long").alias("fiftieths"))
    # whole numbers are added up and divided once: sums of fractions would hang on their order
    return counted.join(s, "dn_id").groupBy("pcap_id").agg(r6(F.sum(F.col("n") * F.col("fiftieths")) / (50.0 * F.sum("n"))).alias("mean"))


@query(f"WITH {FULL}, u AS (SELECT pcap_id, is_r, rcode, eps1, t AS moment FROM m) SELECT p, s, k.t, count(DISTINCT (pcap_id, CAST(floor(moment / s) AS BIGINT))) AS slots, count(*) AS n FROM u, (SELECT unnest(['nx', 'q']) AS p), (SELECT unnest([600, 3600]) AS s), (SELECT unnest([CAST(0.1 AS DOUBLE), 0.3]) AS t) k WHERE (CASE p WHEN 'q' THEN NOT is_r ELSE is_r AND rcode = 3 END) AND eps1 > k.t GROUP BY p, s, k.t")
def joi12_combinations(spark, d):
    """Slots and messages of each combination of packet type, slot size and threshold."""
    from itertools import product

    combinations = spark.createDataFrame(list(product(["nx", "q"], [600, 3600], [0.1, 0.3])), "p string, s int, t double")  # eight rows
    m = msg.with_translated_time(messages(spark, d)).crossJoin(F.broadcast(combinations))
    met = m.filter(F.when(F.col("p") == "q", ~F.col("is_r")).otherwise(F.col("is_r") & (F.col("rcode") == 3)) & (F.col("eps1") > F.col("t")))
    # two levels: no count of distinct values over rows
    by_slot = met.groupBy("p", "s", "t", "pcap_id", F.floor(F.col("time_s_translated") / F.col("s")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return by_slot.groupBy("p", "s", "t").agg(F.count(F.lit(1)).alias("slots"), F.sum("n").alias("n"))


@query(f"WITH {CAPTURES} SELECT c.malware_id, bool_and(dga = n_regionkey % 3) AS same FROM c JOIN nation ON malware_id = n_nationkey GROUP BY c.malware_id")
def joi19_equality_probe(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("malware_id"), (F.col("n_regionkey") % 3).alias("k"))
    return captures(spark, d).join(F.broadcast(n), "malware_id").groupBy("malware_id").agg(F.bool_and(F.col("dga") == F.col("k")).alias("same"))


@query(f"WITH {MESSAGES} SELECT pcap_id, " + ", ".join(f"CAST(sum(CASE WHEN eps{k} > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS pos{k}, CAST(sum(CASE WHEN eps{k} > 0.2 THEN 0 ELSE 1 END) AS BIGINT) AS neg{k}" for k in (1, 2, 3, 4)) + " FROM m0 GROUP BY pcap_id")
def agg2_positives_of_models(spark, d):
    hit = {k: F.col(f"eps{k}") > 0.2 for k in (1, 2, 3, 4)}
    return messages(spark, d).groupBy("pcap_id").agg(*(c for k, h in hit.items() for c in (F.count_if(h).alias(f"pos{k}"), F.count_if(~h).alias(f"neg{k}"))))


@query(f"WITH {TRAFFIC}, {SCORES} SELECT pcap_id, CAST(sum(CASE WHEN value > 0.5 THEN weight ELSE 0 END) AS BIGINT) AS w FROM x JOIN s ON x.dn_id = s.dn_id AND nn_id = 4 GROUP BY pcap_id")
def agg4_weighted_sum(spark, d):
    eager = traffic(spark, d).groupBy("pcap_id", "dn_id").agg(F.sum("weight").alias("weight"))
    return eager.join(scores(spark, d).filter("nn_id = 4"), "dn_id").groupBy("pcap_id").agg(F.sum(F.when(F.col("value") > 0.5, F.col("weight")).otherwise(0)).alias("w"))


@query(f"WITH {TRAFFIC} SELECT pcap_id, count(DISTINCT dn_id) AS u, min(time_s) AS first_s, max(time_s) AS last_s FROM x GROUP BY pcap_id")
def agg6_agg12_distinct_and_bounds(spark, d):
    return traffic(spark, d).groupBy("pcap_id").agg(F.countDistinct("dn_id").alias("u"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


@query(f"WITH {TRAFFIC} SELECT pcap_id, dn_id, is_r, rcode FROM x GROUP BY ALL")
def agg13_group_without_aggregate(spark, d):
    return traffic(spark, d).select("pcap_id", "dn_id", "is_r", "rcode").distinct()


@query(f"WITH {CAPTURES}, {TRAFFIC}, q AS (SELECT dga, CAST(floor(time_s / 31536000) AS BIGINT) AS slotnum, count(*) AS total, count(*) FILTER (WHERE is_r AND rcode = 3) AS pos FROM x JOIN c USING (pcap_id) GROUP BY ALL) SELECT slotnum, " + ", ".join(f"CAST(coalesce(sum(pos) FILTER (WHERE dga = {k}), 0) AS BIGINT) AS pos_{k}, CAST(coalesce(sum(total - pos) FILTER (WHERE dga = {k}), 0) AS BIGINT) AS neg_{k}" for k in (0, 1, 2)) + " FROM q GROUP BY slotnum")
def agg11_agg15_slots_by_class(spark, d):
    slot = slot_of(F.col("time_s"), 31536000).alias("slotnum")
    eager = traffic(spark, d).groupBy("pcap_id", slot).agg(F.count(F.lit(1)).alias("total"), F.count_if(packet_predicate("nx")).alias("pos"))
    wide = eager.join(captures(spark, d).select("pcap_id", "dga"), "pcap_id").groupBy("slotnum").pivot("dga", [0, 1, 2]).agg(F.sum("pos").alias("pos"), F.sum(F.col("total") - F.col("pos")).alias("neg")).na.fill(0)
    return wide.select("slotnum", *(F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in (0, 1, 2) for c in ("pos", "neg")))


@query(f"WITH {CAPTURES} SELECT malware_id, min(name) AS name, count(DISTINCT name) AS n FROM c GROUP BY malware_id")
def agg19_one_of_a_group(spark, d):
    return captures(spark, d).groupBy("malware_id").agg(F.min("name").alias("name"), F.countDistinct("name").alias("n"))


@query(f"WITH {LLR} SELECT cls, round(min(llr), 4) AS least, round(max(llr), 4) AS most, count(*) FILTER (WHERE llr > 0) AS above, round(avg(llr), 4) AS mean FROM lr GROUP BY cls")
def agg32_agg34_llr_bounds(spark, d):
    return _llr(spark, d).groupBy("cls").agg(F.round(F.min("llr"), 4).alias("least"), F.round(F.max("llr"), 4).alias("most"), F.count_if(F.col("llr") > 0).alias("above"), F.round(F.avg("llr"), 4).alias("mean"))


@query("SELECT n_regionkey AS root, round(sum(s_acctbal), 4) AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def agg35_sizes_of_trees(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("root")).agg(F.round(F.sum("s_acctbal"), 4).alias("size"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY ALL")
def agg36_resampled(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.sum((F.col("value") > 20).cast("int")).alias("n"))


@query(f"WITH {FULL} SELECT pcap_id, id, round(time_s - first_value(time_s) OVER (PARTITION BY pcap_id ORDER BY fn), 6) AS t FROM m")
def win4_snk6_time_since_first(spark, d):
    return msg.with_translated_time(messages(spark, d)).select("pcap_id", "id", r6("time_s_translated").alias("t"))


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN rn <= 0.2 * n THEN 'train' ELSE 'test' END AS part FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, count(*) OVER () AS n FROM nation)) GROUP BY part")
def win14_shuffled_split(spark, d):
    n = table(spark, d, "nation")
    total = n.count()
    mixed = n.withColumn("rn", F.row_number().over(W.orderBy(F.xxhash64(F.lit(3), "n_nationkey"), "n_nationkey")))  # a small dimension
    return mixed.groupBy(F.when(F.col("rn") <= 0.2 * total, "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def srt2_srt4_top(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query(f"WITH {SERIES}, p AS (SELECT *, row_number() OVER (PARTITION BY pcap_id ORDER BY pn, slot) AS rn, count(*) OVER (PARTITION BY pcap_id) AS n FROM hs) SELECT pcap_id, slot, rn <= n / 2 AS lower FROM p")
def srt5_median_split(spark, d):
    w = W.partitionBy("pcap_id")
    return series(spark, d).select("pcap_id", "slot", (F.row_number().over(w.orderBy("pn", "slot")) <= F.count(F.lit(1)).over(w) / 2).alias("lower"))


@query(f"WITH {SERIES}, p AS (SELECT *, row_number() OVER (PARTITION BY pcap_id ORDER BY slot) - 1 AS i FROM hs) SELECT pcap_id, slot, pn FROM p WHERE i >= 2 AND i < 10 AND pcap_id IN (1, 3)")
def srt6_srt7_slices(spark, d):
    placed = series(spark, d).filter(F.col("pcap_id").isin(1, 3)).withColumn("i", F.row_number().over(W.partitionBy("pcap_id").orderBy("slot")) - 1)
    return placed.filter("i >= 2 and i < 10").select("pcap_id", "slot", "pn")


@query(f"WITH {NAMES}, {SCORES} SELECT n.dn_id, n.dn, s.value FROM n JOIN s ON n.dn_id = s.dn_id AND s.nn_id = 1")
def set3_columns_by_key(spark, d):
    return names(spark, d).select("dn_id", "dn").join(scores(spark, d).filter("nn_id = 1").select("dn_id", "value"), "dn_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def set4_first_of_duplicates(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT s_suppkey, CASE WHEN len(string_split(x, '.')) = 1 THEN 'tld' WHEN s_suppkey % 3 = 0 THEN 'private' WHEN s_suppkey % 3 = 1 THEN 'icann' ELSE 'unknown' END AS kind FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'a.b' END AS x FROM supplier)")
def str8_suffix_group(spark, d):
    x = F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("a.b")
    section = F.when(F.col("s_suppkey") % 3 == 0, "private").when(F.col("s_suppkey") % 3 == 1, "icann")
    return table(spark, d, "supplier").select("s_suppkey", dom.suffix_group(dom.label_count(x), section).alias("kind"))


@query("SELECT s_suppkey, string_split(x, '_dga_')[1] AS family, string_split(x, '_dga_')[2] AS digest FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || s_suppkey ELSE 'f' || s_suppkey || '_dga_' || s_nationkey END AS x FROM supplier)")
def str9_family_split(spark, d):
    key = F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))
    parts = F.split(F.when(F.col("s_suppkey") % 2 == 0, key).otherwise(F.concat(key, F.lit("_dga_"), F.col("s_nationkey").cast("string"))), "_dga_")
    return table(spark, d, "supplier").select("s_suppkey", F.get(parts, F.lit(0)).alias("family"), F.get(parts, F.lit(1)).alias("digest"))


@query(f"WITH {HOSTS} SELECT page_id, dn <> '' AND NOT starts_with(dn, '.') AND NOT ends_with(dn, '.') AND length(dn) >= 3 AND contains(dn, '.') AS good, replace(dn, '.', '/') AS path, strpos(dn, '.') AS dot FROM h")
def str5_str12_str17_names(spark, d):
    dn = F.col("dn")
    return hosts(spark, d).select("page_id", dom.well_formed(dn).alias("good"), F.translate(dn, ".", "/").alias("path"), F.instr(dn, ".").cast("long").alias("dot"))


@query("SELECT p_partkey, substr(p_name, 1, strpos(p_name || ' ', ' ') - 1) AS first_word, contains(p_type, 'A') AS has_a FROM part")
def str13_str14_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("first_word"), F.contains(F.col("p_type"), F.lit("A")).alias("has_a"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) - 3600 AS berlin FROM events")
def dat1_dat3_conversions(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("text"), F.floor(seconds("ts")).alias("s"), F.floor(seconds("convert_timezone('Europe/Berlin', 'UTC', ts)")).alias("berlin"))


@query("SELECT o_orderkey, TRY_CAST(x AS TIMESTAMP) IS NULL AS bad FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'never' ELSE '2020-01-02 03:04:05' END AS x FROM orders)")
def dat2_coerced_dates(spark, d):
    x = F.when(F.col("o_orderkey") % 3 == 0, "never").otherwise("2020-01-02 03:04:05")
    return table(spark, d, "orders").select("o_orderkey", F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")).isNull().alias("bad"))


@query("SELECT c_custkey, round(c_acctbal / 100, 1) + 0.0 AS r, CAST(ceil(c_acctbal / 100) AS BIGINT) AS up, greatest(least(c_acctbal, 5000), 0) AS clipped FROM customer")
def mth9_round_and_clip(spark, d):
    v = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", (F.round(v / 100, 1) + 0.0).alias("r"), F.ceil(v / 100).alias("up"), F.greatest(F.least(v, F.lit(5000.0)), F.lit(0.0)).alias("clipped"))


@query(f"WITH {SERIES} SELECT pcap_id, coalesce(list(pn ORDER BY slot) FILTER (WHERE pn > 5), []) AS busy, list(pn ORDER BY slot)[pcap_id + 1] AS picked FROM hs GROUP BY pcap_id")
def arr2_arr5_arrays(spark, d):
    a = series(spark, d).groupBy("pcap_id").agg(F.array_sort(F.collect_list(F.struct("slot", "pn"))).alias("l")).withColumn("p", F.col("l.pn"))
    return a.select("pcap_id", F.array_compact(F.transform("p", lambda x: F.when(x > 5, x))).alias("busy"), F.try_element_at("p", (F.col("pcap_id") + 1).cast("int")).alias("picked"))


@query(f"WITH {CAPTURES} SELECT pcap_id, malware_id, dga AS cls, row_number() OVER (ORDER BY pcap_id) - 1 AS place FROM c WHERE pcap_id % 7 > 0")
def an1_source_selection(spark, d):
    own = captures(spark, d).filter(F.col("pcap_id") % 7 > 0)
    return own.select("pcap_id", "malware_id", F.col("dga").alias("cls"), (F.row_number().over(W.orderBy("pcap_id")) - 1).cast("long").alias("place"))  # captures are few


@query(f"WITH {LLR} SELECT pcap_id, wnum, cls = 0 AND wnum % 7 = 2 AS train FROM lr")
def an3_split_by_day(spark, d):
    return windows.split_by_day(_llr(spark, d).withColumn("day", F.col("wnum") % 7), 2).select("pcap_id", "wnum", "train")


@query(f"WITH {LLR}, t AS (SELECT th, cls, count(*) FILTER (WHERE llr >= th) AS hits, count(*) AS n FROM lr, (SELECT unnest(range(-60, 20, 20)) AS th) GROUP BY ALL) SELECT th, cls, CAST(least(floor(hits / n * 4), 3) AS BIGINT) AS quartile, hits FROM t")
def an11_threshold_table(spark, d):
    ths = F.broadcast(spark.range(-60, 20, 20, 1).withColumnRenamed("id", "th"))
    t = _llr(spark, d).crossJoin(ths).groupBy("th", "cls").agg(F.count_if(F.col("llr") >= F.col("th")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return t.select("th", "cls", F.least(F.floor(F.col("hits") / F.col("n") * 4), F.lit(3)).alias("quartile"), "hits")


@query(f"WITH {FULL}, z AS (SELECT pcap_id, " + ", ".join(f"count(*) FILTER (WHERE eps1 >= {a} AND eps1 < {b}) AS z{i}" for i, (a, b) in enumerate(((0, 0.1), (0.1, 0.25), (0.25, 0.5), (0.5, 0.9), (0.9, 1.1)))) + " FROM m GROUP BY pcap_id) SELECT pcap_id, z0 + z1 + z2 AS low, z3 + z4 AS high FROM z")
def an28_threshold_columns(spark, d):
    profile = windows.zone_counts(messages(spark, d), ("pcap_id",), 1)
    return profile.select("pcap_id", windows.over_zones(0.5, False).alias("low"), windows.over_zones(0.5, True).alias("high"))


VIEWS = f"{FULL}, fp AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY pcap_id, dn_id, {c} ORDER BY time_s, id) AS p_{p}" for p, c in PACKET_SQL.items()) + " FROM m)"


@query(f"WITH {VIEWS} SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {p}_all, count(*) FILTER (WHERE {c} AND {FIRST_SQL[p]}) AS {p}_global, count(*) FILTER (WHERE {c} AND p_{p} = 1) AS {p}_pcap" for p, c in PACKET_SQL.items()) + " FROM fp")
def snk9_src21_summary(spark, d):
    return service.summary(messages(spark, d))


@query(f"WITH {MESSAGES} SELECT pcap_id, dn_id, min_by(id, (time_s, id)) AS id FROM m0 WHERE is_r AND rcode = 3 GROUP BY ALL")
def snk9_first_nx_by_capture(spark, d):
    return service.packet_view(messages(spark, d), "nx", "pcap").select("pcap_id", "dn_id", "id")


@query(f"WITH {CAPTURES} SELECT * FROM c WHERE contains(lower(pcap_id || ' ' || malware_id || ' ' || dga || ' ' || name), '7') ORDER BY pcap_id LIMIT 10 OFFSET 10")
def src21_capture_page(spark, d):
    return service.select_captures(captures(spark, d), "7", page=1, size=10)


@query(f"WITH {SERIES}, f AS (SELECT a.slot AS a, CAST(sum(b.pp) AS BIGINT) AS group_sum FROM hs a JOIN hs b ON b.pcap_id = 0 AND b.slot >= a.slot AND b.slot < a.slot + 8 WHERE a.pcap_id = 0 GROUP BY a.slot) SELECT th, round(avg(CASE WHEN group_sum > th THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM f, (SELECT unnest([5, 20, 40]) AS th) GROUP BY th")
def an17_group_rates(spark, d):
    own = series(spark, d).filter("pcap_id = 0")
    dealt = own.withColumn("a", F.explode(F.sequence(F.col("slot") - 7, F.col("slot"))))
    sums = dealt.join(own.select(F.col("slot").alias("a")), "a", "left_semi").groupBy("a").agg(F.sum("pp").alias("s"))
    ths = F.broadcast(spark.createDataFrame([(5,), (20,), (40,)], "th int"))
    return sums.crossJoin(ths).groupBy("th").agg(r6(F.avg((F.col("s") > F.col("th")).cast("double"))).alias("fpr"))


@query(f"WITH {SERIES} SELECT rule, count(*) AS captures FROM (SELECT pcap_id, unnest([2, 5, 10]) AS rule, max(pp) AS most FROM hs GROUP BY pcap_id) WHERE most >= rule GROUP BY rule")
def an24_rule_sweep(spark, d):
    most = series(spark, d).groupBy("pcap_id").agg(F.max("pp").alias("most"))
    rules = F.broadcast(spark.createDataFrame([(2,), (5,), (10,)], "rule int"))
    return most.crossJoin(rules).filter("most >= rule").groupBy("rule").agg(F.count(F.lit(1)).alias("captures"))


@query(f"WITH {SERIES}, mu AS (SELECT avg(pp) FILTER (WHERE pcap_id = 0) AS f, avg(pp) FILTER (WHERE pcap_id > 0) AS t FROM hs) SELECT fp, round(sum(exp(-power(fp - f, 2) / 2) / 2.5066282746310002 * exp(-power(tp - t, 2) / 2) / 2.5066282746310002) / 100, 6) AS p FROM mu, (SELECT i / 10.0::DOUBLE AS fp FROM range(100) t(i)), (SELECT i / 10.0::DOUBLE AS tp FROM range(100) t(i)) WHERE fp + tp > f + t GROUP BY fp")
def an32_density_grid(spark, d):
    """The joint density of healthy and malware counts around the means of the captures' slots, where both together are over the sum of the means."""
    mean = lambda c: F.avg(F.when(c, F.col("pp")))
    means = series(spark, d).agg(mean(F.col("pcap_id") == 0).alias("f"), mean(F.col("pcap_id") > 0).alias("t"))  # one row
    grid = spark.range(100).select((F.col("id") / 10.0).alias("fp")).crossJoin(F.broadcast(spark.range(100).select((F.col("id") / 10.0).alias("tp")))).crossJoin(F.broadcast(means))
    density = lambda c, m: F.exp(-F.pow(F.col(c) - F.col(m), F.lit(2)) / 2) / F.lit(2.5066282746310002)
    return grid.filter(F.col("fp") + F.col("tp") > F.col("f") + F.col("t")).groupBy("fp").agg(r6(F.sum(density("fp", "f") * density("tp", "t")) / 100).alias("p"))


@query()
def an22_sensitivity(spark, d):
    from nxtide.operators.simulate import monte_carlo, sobol_first_order

    means = spark.createDataFrame([(m, 2.0, t, 1.0, 14.0) for m in (6.0, 8.0, 10.0) for t in (4.0, 8.0)], "mean_fp double, sd_fp double, mean_tp double, sd_tp double, th double")
    return sobol_first_order(monte_carlo(means, 20, 1), ["mean_fp", "mean_tp"], "tpr").select("parameter", r6("index").alias("index"))


@query()
def an29_forest(spark, d):
    from nxtide.operators.learning import cross_validated, varied

    rows = full_messages(spark, d).select("id", (F.col("rcode") == 3).cast("int").alias("y"), "eps1", "eps2", F.col("fn_req").cast("double").alias("place"), F.lit(1.0).alias("still"))
    features = varied(rows, ["eps1", "eps2", "place", "still"])
    return cross_validated(rows, "y", features, k=2, trees=5).groupBy("fold", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def an29_one_class(spark, d):
    from nxtide.operators.learning import distance, one_class

    s = series(spark, d)
    profile, limit = one_class(s.filter("pcap_id = 0"), ["pn", "pp"])
    return distance(s, profile, ["pn", "pp"]).groupBy("pcap_id").agg(F.count_if(F.col("distance") > limit).alias("n"))


@query(f"WITH {SERIES} SELECT pcap_id, round(avg(pp) + coalesce(stddev_samp(pp), 1) * 2.3263478740408408, 6) AS th FROM hs GROUP BY pcap_id")
def mth8_threshold_for_rate(spark, d):
    from nxtide.functions.distributions import normal_quantile

    stats = series(spark, d).groupBy("pcap_id").agg(F.avg("pp").alias("m"), F.coalesce(F.stddev_samp("pp"), F.lit(1.0)).alias("s"))
    return stats.select("pcap_id", r6(normal_quantile(F.lit(0.99), F.col("m"), F.col("s"))).alias("th"))
