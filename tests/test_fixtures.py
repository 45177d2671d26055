"""Small fixtures with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from nxtide.functions.domains import encoded
from nxtide.functions.packets import logit, truncated, zone
from nxtide.operators import curves, messages, slots, suffixes, windows

ROWS = [(0, 100.0, 10, False, None), (1, 100.1, 10, True, 3), (2, 150.0, 11, False, None), (3, 150.2, 11, True, 0), (4, 3800.0, 10, False, None), (5, 3800.1, 10, True, 3), (6, 3900.0, 12, False, None), (7, 3900.3, 12, True, 3)]
EPS = {10: 0.9, 11: 0.2, 12: 1.0}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, 1, t, dn, r, c, EPS[dn], None) for i, t, dn, r, c in ROWS]
    df = spark.createDataFrame(rows, "id long, pcap_id long, time_s double, dn_id long, is_r boolean, rcode int, eps1 double, rank_dn long")
    return messages.with_counters(messages.with_first_seen(df)).withColumn("time_s_translated", F.col("time_s"))


def test_slot_report(small):
    rows = {r["slotnum"]: r.asDict() for r in slots.slot_report(small).collect()}
    want = {
        0: dict(u=2, qr=4, q=2, r=2, nx=1, ok=1, gqr=2, gq=2, gr=2, gnx=1, gok=1, qr_pos=2, nx_pos=1, gnx_pos=1),
        1: dict(u=2, qr=4, q=2, r=2, nx=2, ok=0, gqr=1, gq=1, gr=1, gnx=1, gok=0, qr_pos=4, nx_pos=2, gnx_pos=1),
    }
    for slot, cells in want.items():
        assert {k: rows[slot][k] for k in cells} == cells


def test_count_windows_and_configurations(spark, small):
    found = {r["wnum"]: r for r in windows.count_windows(small, 2).collect()}
    assert [(found[w][c]) for w in (0, 1) for c in ("qr", "u", "q", "r", "nx")] == [4, 2, 2, 2, 1, 4, 2, 2, 2, 2]
    grid = windows.config_grid(spark, ninf=[-50.0], pinf=[50.0], wl_rank=[10], wl_value=[0.0], unique=[False, True], packet=["qr"])
    llr = {(r["wnum"], r["cfg"]): r["llr"] for r in windows.apply_configs(small, grid, 2).collect()}
    for key, value in {(0, 1): 0.810930, (0, 0): 1.621860, (1, 1): 52.197225, (1, 0): 104.394449}.items():
        assert llr[key] == pytest.approx(value, abs=1e-6)


def test_capture_profile(small):
    r = messages.dga_ratio(small).first()
    assert (r["qr"], r["q"], r["r"], r["u"], r["fnreq_max"]) == (8, 4, 4, 3, 3)
    assert r["dga_ratio"] == pytest.approx(0.520833, abs=1e-6)


SUFFIXES = [("com", "tld"), ("jp", "tld"), ("net", "tld"), ("cn", "tld"), ("co.jp", "icann"), ("com.cn", "icann"), ("ddns.net", "private"), ("s3.cn-north-1.amazonaws.com.cn", "private")]


@pytest.mark.parametrize("dn, want", [
    ("wWw.eXaMpLe.cO.Jp", (2, "example.co.jp", "jp", "co.jp", None, "www.example.co", "www.example", "www.example")),
    ("x1.ddns.net", (2, "x1.ddns.net", "net", None, "ddns.net", "x1.ddns", "x1.ddns", "x1")),
    ("example.com", (1, "example.com", "com", None, None, "example", "example", "example")),
    ("compute.example.com", (1, "example.com", "com", None, None, "compute.example", "compute.example", "compute.example")),
    ("atim.s3.cn-north-1.amazonaws.com.cn", (3, "atim.s3.cn-north-1.amazonaws.com.cn", "cn", "com.cn", "s3.cn-north-1.amazonaws.com.cn", "atim.s3.cn-north-1.amazonaws.com", "atim.s3.cn-north-1.amazonaws", "atim")),
    ("www.example.unknowntld", (0, "www.example.unknowntld", None, None, None, "www.example.unknowntld", "www.example.unknowntld", "www.example.unknowntld")),
    (".example.com", (-1,) + (None,) * 7), ("example.com.", (-1,) + (None,) * 7), ("", (-1,) + (None,) * 7), (None, (None,) * 8),
])
def test_suffixes(spark, dn, want):
    out = suffixes.parse_domains(spark.createDataFrame([(dn,)], "dn string"), spark.createDataFrame(SUFFIXES, "suffix string, group string")).first()
    assert tuple(out[c] for c in ("rcode", "bdn", "tld", "icann", "private", "dn_tld", "dn_icann", "dn_private")) == want


def test_overlap(spark):
    healthy = spark.createDataFrame(list(enumerate([1, 0, 2, 1, 0, 0, 1, 1])), "slot long, pos long")
    capture = spark.createDataFrame([(i, v, v) for i, v in enumerate([0, 3, 0, 1, 0, 0, 2, 0])], "slot long, activity long, pos long")
    r = slots.overlap_compare(healthy, capture).first()
    assert (r["ta"], r["ma"], r["fa"], r["tn"], r["first_ta"], r["first_ma"]) == (2, 1, 0, 5, 2, 4)


def test_rolling_and_gap_fill(spark):
    s = slots.gap_fill(spark.createDataFrame([(i, i) for i in range(10) if i != 3], "slot long, pp long"), "slot", fill={"pp": 3})
    out = {r["slot"]: r["s"] for r in slots.rolling(s, "slot", 8, {"s": F.sum("pp")}).collect()}
    assert [out[i] for i in range(10)] == [None] * 7 + [28, 36, 44]


def test_roc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    points = curves.roc(df, "y", "s")
    assert [(r["fpr"], r["tpr"]) for r in points.orderBy(F.desc("threshold")).collect()] == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert curves.auc(points).first()["auc"] == 0.75
    best = curves.best_threshold(points).first()
    assert (best["threshold"], best["gain"]) == (0.8, 0.5)
    assert curves.partial_auc(points, 1.0).first()["raw"] == 0.75


def plain_roc(rows):
    """Points (threshold, tp, fp) of (label, score), highest first, after one at infinity."""
    points = [(float("inf"), 0, 0)]
    for score in sorted({s for _, s in rows}, reverse=True):
        points.append((score, sum(y for y, s in rows if s >= score), sum(1 - y for y, s in rows if s >= score)))
    return points


@pytest.mark.parametrize("by", [(), ("g",)])
def test_roc_of_many_scores_equals_plain_sums(spark, by):
    # most scores lie close together; more of them than there are buckets
    rows = [(i % 2, (i * 7919 % 13) // 7, round((i * 104729 % 1009) ** 3 / 1009**3, 6)) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, y int, s double").repartition(4)
    points, bent = (curves.roc(df, "y", "s", by, drop) for drop in (False, True))
    for g in (0, 1) if by else (None,):
        own = [(y, s) for h, y, s in rows if g in (None, h)]
        at = (lambda f: f.filter(F.col("g") == g)) if by else lambda f: f
        ranked = lambda f: [tuple(r) for r in at(f).orderBy(F.desc("threshold")).select("threshold", "tp", "fp").collect()]
        want = plain_roc(own)
        assert ranked(points) == want
        flat = [0 < i < len(want) - 1 and all(want[i + 1][k] - want[i][k] == want[i][k] - want[i - 1][k] for k in (1, 2)) for i in range(len(want))]
        assert ranked(bent) == [w for w, f in zip(want, flat) if not f]
        (_, tp, fp), steps = want[-1], list(zip(want, want[1:]))
        area = sum((b[2] - a[2]) * (a[1] + b[1]) / 2 for a, b in steps) / tp / fp
        assert abs(at(curves.auc(points, by)).first()["auc"] - area) < 1e-9
        assert abs(at(curves.auc(bent, by)).first()["auc"] - area) < 1e-9
        assert abs(at(curves.partial_auc(points, 1.0, by)).first()["raw"] - area) < 1e-9


def test_roc_without_rows(spark):
    none = curves.roc(spark.createDataFrame([], "y int, s double"), "y", "s")
    assert [(r["threshold"], r["tp"], r["tpr"]) for r in none.collect()] == [(float("inf"), 0, None)]
    assert curves.auc(none).first()["auc"] is None


def test_encoder(spark):
    ids = spark.createDataFrame([("a-b.com",)], "dn string").select(encoded(F.col("dn")).alias("x")).first()["x"]
    assert ids == [16, 28, 26, 2, 14, 1, 15] + [0] * 53


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.95,)], "e double")
    assert [r[0] for r in df.select(logit(F.col("e"))).collect()][:3] == [-50.0, 50.0, 0.0]
    assert [r[0] for r in df.select(zone(F.col("e"))).collect()] == [0, 4, 3, 4]
    assert [r[0] for r in spark.createDataFrame([(-4.2,), (4.2,)], "v double").select(truncated(F.col("v"), 3)).collect()] == [-3, 3]


def test_empty_tables(spark, small):
    none = small.limit(0)
    assert slots.slot_report(none).count() == 0
    assert windows.count_windows(none).count() == 0
    assert messages.dga_ratio(none).count() == 0


def test_simulations_are_repeatable(spark):
    from nxtide.operators.simulate import daily_traffic, monte_carlo

    grid = spark.createDataFrame([(6.0, 2.0, 8.0, 1.0, 14.0)], "mean_fp double, sd_fp double, mean_tp double, sd_tp double, th double")
    a, b = (sorted(map(tuple, monte_carlo(grid.repartition(n), 20, 1).collect())) for n in (1, 3))
    assert a == b and all(x[-1] >= x[-2] for x in a)
    total = daily_traffic(spark.range(3).withColumnRenamed("id", "day"), 1).groupBy("day").agg(F.sum("requests").alias("n")).collect()
    assert all(math.isclose(r["n"], 1000 * 4 * math.sqrt(2 * math.pi), rel_tol=0.15) for r in total)
