"""Windows under configurations: zones at their own bounds, nothing shuffled by configuration, null values of parameters."""

import math

import pytest
from pyspark.sql import functions as F

from nxtide.operators import windows
from nxtide.plans import detection, zones
from nxtide.plans.relational import grid
from nxtide.plans.star import full_messages


def test_bounds_come_of_the_sums_that_they_bound(spark, tiny):
    applied = zones._applied(spark, tiny)
    assert all("nxtide-" in f for f in applied.inputFiles())  # a table: made again, sums could differ in their last bit
    limits = windows.thresholds(applied.filter("cls = 0"))
    below = windows.detect_zones(applied.filter("cls = 0"), limits, ("cfg",)).filter("zone = 0")
    assert below.agg({"llr": "sum"}).first()[0] == 0


@pytest.mark.parametrize("make", [windows.apply_configs, windows.apply_configs_to_messages])
@pytest.mark.parametrize("inc", [None, 0.1])
def test_windows_that_hold_the_same_tie(spark, make, inc):
    rows = [(p, 1000 * p + k, 0, v % 3 > 0, 3 if v % 7 > 3 else 0, v / 103, None) for p in range(20) for k in range(101) for v in [k * (p + 1) % 101]]
    m = spark.createDataFrame(rows, "pcap_id long, dn_id long, fn_req long, is_r boolean, rcode int, eps1 double, rank_dn long").repartition(7)
    g = grid(spark) if inc is None else grid(spark).withColumn("nx_inc", F.lit(inc))
    values = make(m, g).groupBy("cfg").agg(F.count_distinct("llr").alias("n"), F.count("llr").alias("windows")).collect()
    assert len(values) == 96 and {(r["n"], r["windows"]) for r in values} == {(1, 20)}


def test_zones_of_captures_that_hold_the_same(spark, tmp_path):
    """A window of each capture has the same names' scores in another order: none is below the bound that all of them set."""
    rows = [(100 * k + p, 10 * (7 + k) + p, "view" if v % 2 else "error", float(v)) for p in range(10) for k in range(97) for v in [1 + k * (2 * p + 3) % 97]]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)")).repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    found = zones.snk15_detection_table(spark, str(tmp_path)).collect()
    assert len(found) == 288 and {(r["cls"], r["llr_0"], r["llr_2"]) for r in found} == {(0, 0, 4), (1, 0, 3), (2, 0, 3)}
    assert {tuple(r) for r in detection.an5_llr_zones(spark, str(tmp_path)).collect()} == {(0, 2, 4), (1, 2, 3), (2, 2, 3)}


@pytest.mark.parametrize("make", [windows.apply_configs, windows.apply_configs_to_messages])
def test_nothing_is_shuffled_by_configuration(spark, tiny, make):
    plan = make(full_messages(spark, tiny), grid(spark))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and not any("cfg#" in line.split("hashpartitioning(")[1] or "packet#" in line.split("hashpartitioning(pcap_id")[-1] for line in keys if "pcap_id" in line)


def test_null_scores_and_parameters(spark):
    rows = [(1, n, 0, False, 0, e, r) for n, e, r in ((1, 0.5, 5), (2, 1.0, None), (3, 0.0, None), (4, 0.8, None), (5, None, None))] + [(2, 1, 0, False, 0, None, None)]
    m = spark.createDataFrame(rows, "pcap_id long, dn_id long, fn_req long, is_r boolean, rcode int, eps1 double, rank_dn long")
    g = spark.createDataFrame([(0, -50.0, 20.0, 9, -7.0, True, "qr"), (1, None, 20.0, 9, None, True, "q"), (2, -50.0, 20.0, None, -7.0, False, "r")], "cfg long, ninf double, pinf double, wl_rank int, wl_value double, unique boolean, packet string")
    got = {(r["pcap_id"], r["cfg"]): (r["llr"], r["listed"], r["wcount"]) for r in windows.apply_configs(m, g).collect()}
    x = math.log(4)
    want = {(1, 0): (-50 + 20 - 7 + x, 1, 5), (1, 1): (20 + x, 1, 5), (1, 2): (0.0, 0, 5), (2, 0): (None, 0, 1), (2, 1): (None, 0, 1), (2, 2): (None, 0, 1)}
    assert got.keys() == want.keys() and all((a[0] is None) == (b[0] is None) and (a[0] is None or math.isclose(a[0], b[0], abs_tol=1e-9)) and a[1:] == b[1:] for a, b in ((got[k], want[k]) for k in want))
