"""Slot pairs against plain loops, tables with several header rows, loads that fail and go on."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nxtide.operators import pairs
from nxtide.sources import headed
from nxtide.streaming import resume

SETTINGS = [(0, 1.0, 0.0, 0.0), (1, 0.5, 1.0, 2.0)]


def test_slot_pairs_equal_plain_loops(spark):
    rng = random.Random(3)
    healthy = [rng.choice([0, 0, 2, 5]) for _ in range(11)]
    series = {c: [rng.choice([0, 0, 1, 4, 9]) for _ in range(n)] for c, n in ((1, 30), (2, 9), (3, 8), (4, 70))}
    draws = {(1, c, s, o): rng.gauss(1, 2) for c, v in series.items() for s in range(len(v)) for o in range(8)}
    dropped = next(iter(draws))
    table = spark.createDataFrame([(*k, d) for k, d in draws.items() if k != dropped], "setting long, pcap_id long, start long, at long, draw double")
    h = spark.createDataFrame(list(enumerate(healthy)), "slot long, pos long")
    c = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "pcap_id long, slot long, pos long")
    s = spark.createDataFrame(SETTINGS, "setting long, scale double, mean double, deviation double")
    want = {}
    for setting, scale, _, deviation in SETTINGS:
        th = max(healthy[:8]) * scale
        for k, vs in series.items():
            for start in range(min(len(vs) - 8, 50)):
                cells = [0] * 6
                for o in range(8):
                    m = 1 if not deviation or (setting, k, start, o) == dropped else math.ceil(draws[setting, k, start, o])
                    base, pos = healthy[o] * (1 if m < 0 else m), vs[start + o]
                    over = base + pos > th
                    for i, x in enumerate((base > th, base > 0, pos == 0 and over, pos == 0, pos > 0 and over, pos > 0)):
                        cells[i] += x
                want[setting, k, start] = (*cells, cells[4] > 0)
    out = pairs.slot_pairs(h, c, s, table)
    assert {(r["setting"], r["pcap_id"], r["start"]): tuple(r)[3:] for r in out.collect()} == want
    rates = {(r["setting"], r["pcap_id"]): r for r in pairs.pair_rates(out).collect()}
    own = [v for (a, k, _), v in want.items() if (a, k) == (1, 4)]
    ratios = [x[2] / x[3] for x in own if x[3]]
    r = rates[1, 4]
    assert (r["groups"], r["fn_groups"], r["fn"]) == (50, sum(not x[6] for x in own), sum(x[5] - x[4] for x in own))
    assert math.isclose(r["fpr_mean"], sum(ratios) / len(ratios)) and math.isclose(r["fpr_max"], max(ratios)) and (2, 3) not in rates
    drawn = pairs.slot_pairs(h, c, s, seed=5)
    assert sorted(map(str, drawn.collect())) == sorted(map(str, pairs.slot_pairs(h, c.repartition(3), s, seed=5).collect()))
    assert pairs.slot_pairs(h, c.limit(0), s).count() == 0 and pairs.slot_pairs(h, c, s, starts=None).filter("pcap_id = 4").count() == 2 * 62


def test_draws_are_normal(spark):
    x = spark.range(20_000).select(pairs.normal_draw(F.lit(3.0), F.lit(2.0), F.col("id")).alias("x")).agg(F.avg("x"), F.stddev("x"), F.avg((F.abs(F.col("x") - 3) < 2).cast("int"))).first()
    assert abs(x[0] - 3) < 0.06 and abs(x[1] - 2) < 0.05 and abs(x[2] - 0.683) < 0.015


def test_headed_tables(spark, tmp_path):
    rows = [("id", 0.5, None, 1), ("a, \"b\"", 1.5, "", 2), (None, None, "x", 3), ("-", -1e-9, "-", 4), ("é 日", 0.1, " y ", None)]
    df = spark.createDataFrame(rows, "id string, eps_tld_0 double, eps_tld_1 string, time_s long")
    levels = {"eps_tld_0": ("eps", "tld", "0"), "eps_tld_1": ("eps", "tld", "1"), "time_s": ("time_s",)}
    path = str(tmp_path / "t")
    headed.write_headed(df.repartition(3), path, levels)
    back = headed.read_headed(spark, path, 3, "id string, eps_tld_0 double, eps_tld_1 string, time_s long")
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    text = headed.read_headed(spark, path, 3)
    assert text.columns == df.columns and text.count() == 5
    # rows that look like the header rows are rows
    twin = spark.createDataFrame([("id", "eps", "eps", "time_s"), ("-", "tld", "tld", "-"), ("-", "0", "1", "-")] * 2, "id string, eps_tld_0 string, eps_tld_1 string, time_s string")
    headed.write_headed(twin.coalesce(1), str(tmp_path / "twin"), levels)
    assert headed.read_headed(spark, str(tmp_path / "twin"), 3).count() == 6
    headed.write_headed(df.limit(0), str(tmp_path / "none"), levels)
    assert headed.read_headed(spark, str(tmp_path / "none"), 3, "id string, eps_tld_0 double, eps_tld_1 string, time_s long").count() == 0
    with pytest.raises(Exception, match="line break"):
        headed.write_headed(spark.createDataFrame([("a\nb",)], "id string"), str(tmp_path / "bad"), {"id": ("id", "x")})


def test_headers_are_told_in_split_files(spark, tmp_path):
    df = spark.range(4000).select(F.col("id"), F.lit("some longer text").alias("a_b"))
    path = str(tmp_path / "t")
    headed.write_headed(df.coalesce(1), path, {"a_b": ("a", "b")})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        back = headed.read_headed(spark, path, 2, "id long, a_b string")
        assert back.rdd.getNumPartitions() > 3 and back.count() == 4000 and back.agg(F.sum("id")).first()[0] == 3999 * 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_load_that_fails_goes_on(spark, tmp_path):
    schema, places = "id long, text string", [str(tmp_path / x) for x in ("rows", "records", "state")]
    for k in range(5):
        spark.createDataFrame([(10 * k + i, f"t{i}") for i in range(10)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert resume.loaded(spark, *places[:2], schema).count() == 0

    def fail(batch_id):
        if batch_id == 2:
            raise RuntimeError("third batch")

    with pytest.raises(Exception, match="third batch"):
        resume.start_load(stream(), *places, before_record=fail).awaitTermination()
    assert resume.records(spark, places[1]).count() == 2
    assert resume.loaded(spark, *places[:2], schema).count() == 20  # the third batch's rows are there, but not in
    resume.start_load(stream(), *places).awaitTermination()
    rows = resume.loaded(spark, *places[:2], schema)
    assert sorted(r["id"] for r in rows.collect()) == list(range(50)) and rows.select("batch_id").distinct().count() == 5
    # without its checkpoint the load begins again: recorded batches are left alone
    resume.start_load(stream(), *places[:2], str(tmp_path / "new state")).awaitTermination()
    assert resume.loaded(spark, *places[:2], schema).count() == 50
    with pytest.raises(Exception, match="recorded with other rows"):
        resume.start_load(stream().filter("id > 3"), *places[:2], str(tmp_path / "other state")).awaitTermination()
    resume.reset(spark, *places)
    assert resume.records(spark, places[1]).count() == 0
    resume.start_load(stream(), *places).awaitTermination()
    assert resume.loaded(spark, *places[:2], schema).count() == 50
