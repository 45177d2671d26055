"""Queries that write a table as files of a format and read them again: sources and sinks by a round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nxtide.operators import service, windows
from nxtide.operators.scratch import new_path as place
from nxtide.plans.registry import query
from nxtide.plans.star import FULL, NAMES, TRAFFIC, full_messages, names, seconds, table, traffic
from nxtide.sources import readers

#: Event ids from the first to the last of a JSON list.
LIST = 20_000


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a \"quoted, name\"' ELSE c_name END AS name, c_acctbal FROM customer")
def snk1_src8_csv_round_trip(spark, d):
    path, quoted = place(spark), {"quote": '"', "escape": '"', "header": True}
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 'a "quoted, name"').otherwise(F.col("c_name")).alias("name"), "c_acctbal")
    rows.write.mode("append").options(**quoted).csv(path)
    return spark.read.schema(rows.schema).options(**quoted).csv(path)


@query(f"WITH {TRAFFIC} SELECT pcap_id % 16 AS part, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM x WHERE pcap_id % 16 IN (1, 5) GROUP BY ALL")
def snk2_snk3_snk8_partitions(spark, d):
    """Two appends to a partitioned table, of which a reader opens two partitions."""
    path = place(spark)
    rows = traffic(spark, d).withColumn("part", F.col("pcap_id") % 16)
    for half in (0, 1):
        rows.filter(F.col("dn_id") % 2 == half).repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).filter(F.col("part").isin(1, 5)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src17_json_round_trip(spark, d):
    path = place(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT 4 AS files, true AS filled")
def src18_file_list(spark, d):
    path = place(spark)
    table(spark, d, "nation").repartition(4, "n_nationkey").write.mode("append").option("maxRecordsPerFile", 0).json(path)
    found = service.file_list(spark, path, "*.json")
    return found.agg(F.count(F.lit(1)).cast("int").alias("files"), F.bool_and(F.col("length") > 0).alias("filled"))


@query("SELECT p_partkey, p_name, sha256(p_name) AS digest, true AS sound FROM part")
def src20_objects_with_digests(spark, d):
    """Objects with the digest of their bytes, compared when they are read."""
    path = place(spark)
    table(spark, d, "part").select("p_partkey", "p_name", F.sha2("p_name", 256).alias("digest")).write.mode("append").parquet(path)
    held = spark.read.schema("p_partkey bigint, p_name string, digest string").parquet(path)
    return held.withColumn("sound", F.col("digest") == F.sha2("p_name", 256))


@query(f"WITH {FULL}, pn AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, max(eps1) AS e1, max(eps4) AS e4, max(rank_dn) AS rank FROM m GROUP BY ALL) SELECT pcap_id, wnum, count(*) FILTER (WHERE rank > 0 AND rank < 11) AS whitelisted_10, count(*) FILTER (WHERE e4 >= 0.1 AND e4 < 0.25) AS eps_4_1, count(*) FILTER (WHERE e1 >= 1) AS pinf_1, round(coalesce(sum(ln(e4 / (1 - e4))) FILTER (WHERE e4 > 0 AND e4 < 1 AND NOT coalesce(rank > 0 AND rank < 16, false)), 0), 4) AS llr_4_15 FROM pn GROUP BY ALL")
def snk14_window_file(spark, d):
    """The wide table of windows with all models, zones and whitelist levels, written as CSV with one flattened header."""
    path = place(spark)
    wide = windows.window_profile(full_messages(spark, d))
    wide.write.mode("append").option("header", True).csv(path)
    held = spark.read.schema(wide.schema).option("header", True).csv(path)
    return held.select("pcap_id", "wnum", "whitelisted_10", "eps_4_1", "pinf_1", F.round("llr_4_15", 4).alias("llr_4_15"))


@query(f"WITH {NAMES} SELECT count(*) AS n, true AS there FROM n")
def snk13_existence_and_count(spark, d):
    name = f"nx_{uuid.uuid4().hex}"
    names(spark, d).createOrReplaceTempView(name)
    return spark.table(name).agg(F.count(F.lit(1)).alias("n")).withColumn("there", F.lit(service.exists(spark, name)))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def str18_repaired_encoding(spark, d):
    """Bytes that are no UTF-8 are put into each text, and dropped again."""
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("text", "utf-8"), F.unhex(F.lit("C3")))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", service.repaired(broken).alias("text"))


@query("SELECT s_suppkey, 'a/b.' || s_suppkey || '.c' AS dn FROM supplier")
def str17_bidi_marks_and_first_dot(spark, d):
    from nxtide.functions.domains import first_dot, without_bidi_marks

    raw = F.concat(F.lit("\u200ea.b\u200f."), F.col("s_suppkey").cast("string"), F.lit("\u200e.c"))
    return table(spark, d, "supplier").select("s_suppkey", first_dot(without_bidi_marks(raw), "/").alias("dn"))


@query("SELECT k, round((SELECT avg(exp(-power((k * 300 - c_acctbal) / 900.0, 2) / 2)) FROM customer) / CAST(2255.9654358379 AS DOUBLE), 9) AS density FROM (SELECT i AS k FROM range(30) t(i))")
def agg37_kernel_density(spark, d):
    from nxtide.operators.curves import kernel_density

    at = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 300.0).alias("at"))
    return kernel_density(table(spark, d, "customer"), "c_acctbal", at, 900.0).select("k", F.round("density", 9).alias("density"))


@query("""SELECT epoch_us(ts) / 1e6 AS time_s, 'h"' || user_id AS src, 'a, b' AS dst, CAST(event_id AS BIGINT) AS fn_req, CAST(user_id % 5 AS INTEGER) AS qcode, event_type NOT IN ('view', 'click') AS is_r,
  CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS rcode, 'n' || user_id || '.com' AS dn, CASE WHEN user_id % 3 > 0 THEN 'r' || chr(10) || user_id END AS answer FROM events""")
def src8_snk1_messages_csv(spark, d):
    """Parsed messages written and read as the library's CSV, with quotes, separators, line breaks and nulls in values."""
    path = place(spark) + "/csv"
    e, user, none = table(spark, d, "events"), F.col("user_id").cast("string"), F.lit(0)
    rows = e.select(
        seconds("ts").alias("time"), none.alias("size"), F.lit("udp").alias("protocol"), F.concat(F.lit('h"'), user).alias("src"), F.lit("a, b").alias("dst"), F.when(F.col("event_type").isin("view", "click"), "q").otherwise("r").alias("qr"),
        F.lit("").alias("AA"), F.when(F.col("event_type") == "error", 3).otherwise(0).alias("rcode"), F.col("event_id").alias("fnreq"), *(none.alias(c) for c in ("qdcount", "ancount", "nscount", "arcount")),
        (F.col("user_id") % 5).cast("int").alias("qcode"), F.concat(F.lit("n"), user, F.lit(".com")).alias("dn"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("r\n"), user)).alias("answer"),
    )
    readers.write_csv(rows, path)
    return readers.messages_of(readers.read_messages(spark, path))


@query(f"WITH {TRAFFIC} SELECT pcap_id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM x GROUP BY pcap_id")
def snk2_snk3_append_messages(spark, d):
    """Two appends of the library to one table in parts of captures."""
    path, rows = place(spark) + "/messages", traffic(spark, d)
    for half in (0, 1):
        readers.append_messages(rows.filter(F.col("dn_id") % 2 == half), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("SELECT p_partkey, p_name, sha256(p_name) AS sha256 FROM part")
def src20_library_objects(spark, d):
    """Objects written with their digests and read through the check of each."""
    path = place(spark) + "/objects"
    readers.write_objects(table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"), F.col("p_name").cast("binary").alias("data")), path)
    return readers.read_objects(spark, path).select("p_partkey", F.col("data").cast("string").alias("p_name"), "sha256")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src17_library_json(spark, d):
    """Files of one JSON list each, over several lines, through the library's reader."""
    path = place(spark) + "/json"
    rows = table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))
    lists = rows.groupBy(F.expr(f"event_id div {LIST}").alias("part")).agg(F.collect_list(F.to_json(F.struct("event_id", "user_id", "k"))).alias("items"))
    lists.select("part", F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]")).alias("value")).write.mode("append").partitionBy("part").text(path)  # a folder and file for each list
    return service.read_json(spark, path, "event_id long, user_id long, k long").drop("part")
