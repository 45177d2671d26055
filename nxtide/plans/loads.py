"""Queries over slot pairs of all captures, the wide window table as a file, a load that fails and goes on, and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from nxtide.operators import learning, pairs, scoring, windows
from nxtide.operators.scratch import new_path
from nxtide.plans.detection import WIN
from nxtide.plans.registry import query
from nxtide.plans.relational import FILLED, filled, r6
from nxtide.plans.star import full_messages, hosts, table
from nxtide.sources import headed
from nxtide.streaming import resume

#: (setting, scale, mean, deviation)
SETTINGS = [(0, 1.0, 0.0, 0.0), (1, 0.5, 1.0, 1.0), (2, 1.5, 1.0, 0.5)]
RATIOS = ("fpr0", "fpr", "tpr")


def _settings(spark):
    return spark.createDataFrame(SETTINGS, "setting long, scale double, mean double, deviation double")


def _day(spark, d):
    """(healthy, captures): the first slots of capture 0, and all slots of the others, as far as they have over 8."""
    f = filled(spark, d)
    return f.filter("pcap_id = 0 and slot < 8").select("slot", F.col("pp").alias("pos")), f.filter("pcap_id > 0").select("pcap_id", "slot", F.col("pp").alias("pos"))


PAIRS = f"""{FILLED}, hb AS (SELECT slot AS o, pp AS base FROM fs WHERE pcap_id = 0 AND slot < 8), se AS (SELECT * FROM (VALUES {", ".join(f"({a}, CAST({b} AS DOUBLE), {d})" for a, b, _, d in SETTINGS)}) t(setting, scale, deviation)),
la AS (SELECT pcap_id, max(slot) - 8 AS last FROM fs WHERE pcap_id > 0 GROUP BY pcap_id), st AS (SELECT pcap_id, unnest(range(0, least(last + 1, 50))) AS start FROM la),
bo AS (SELECT setting, st.pcap_id, start, pp AS pos, (SELECT max(base) FROM hb) * scale AS th, ((31 * st.pcap_id + 17 * start + 7 * o + setting) % 9 - 2) / 2.0 AS draw, deviation, base AS base0
  FROM st JOIN fs f ON f.pcap_id = st.pcap_id AND f.slot >= start AND f.slot < start + 8 JOIN hb ON hb.o = f.slot - start, se),
bm AS (SELECT *, base0 * CASE WHEN deviation <= 0 OR ceil(draw) < 0 THEN 1 ELSE ceil(draw) END AS base FROM bo),
pr AS (SELECT setting, pcap_id, start, count(*) FILTER (WHERE base > th) AS fp0, count(*) FILTER (WHERE base > 0) AS n0, count(*) FILTER (WHERE pos = 0 AND base + pos > th) AS fp, count(*) FILTER (WHERE pos = 0) AS n,
  count(*) FILTER (WHERE pos > 0 AND base + pos > th) AS tp, count(*) FILTER (WHERE pos > 0) AS p FROM bm GROUP BY ALL)"""


@query(f"""WITH {PAIRS}, ra AS (SELECT *, fp0 / nullif(n0, 0) AS fpr0, fp / nullif(n, 0) AS fpr, tp / nullif(p, 0) AS tpr FROM pr),
va AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {c} BETWEEN 0 AND 1 THEN {c} END AS {c}" for c in RATIOS)}) FROM ra)
SELECT setting, pcap_id, round(avg(fpr0), 6) AS fpr0_mean, {", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("fpr", "tpr") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min")))},
  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) - sum(tp) AS BIGINT) AS fn, CAST(sum(p) AS BIGINT) AS p, count(*) FILTER (WHERE tp = 0) AS fn_groups, count(*) AS groups, round(avg(CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END), 6) AS tpr_groups
FROM va GROUP BY setting, pcap_id""")
def an17_slot_pairs(spark, d):
    """Slot pairs of every capture at three settings; the multipliers come as a table, so that SQL has the same."""
    healthy, captures = _day(spark, d)
    places = captures.select("pcap_id", "slot").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>"))).withColumn("start", F.col("slot") - F.col("at")).filter("start >= 0").select("pcap_id", "start", "at")
    draw = ((31 * F.col("pcap_id") + 17 * F.col("start") + 7 * F.col("at") + F.col("setting")) % 9 - 2) / F.lit(2.0)
    draws = places.crossJoin(F.broadcast(_settings(spark).select("setting"))).select("setting", "pcap_id", "start", "at", draw.alias("draw"))  # three settings
    rates = pairs.pair_rates(pairs.slot_pairs(healthy, captures, _settings(spark), draws))
    return rates.withColumns({c: r6(c) for c in rates.columns if c.split("_")[0] in (*RATIOS, "tpr")})


MODELS, LEVELS, ZONES = (1, 2, 3, 4), (0, 10, 15, 50), ((0, 0.1), (0.1, 0.25), (0.25, 0.5), (0.5, 0.9), (0.9, 1.1))
SCALARS = ("pcap_id", "wnum", "qr", "q", "r", "nx", "u", "time_s_start", "time_s_end", "fn_req_min", "fn_req_max")


def header_levels() -> dict[str, tuple]:
    """The three header parts of each column of the wide window table."""
    out = {c: (c,) for c in SCALARS} | {f"whitelisted_{n}": ("whitelisted", str(n)) for n in LEVELS}
    for k in MODELS:
        out |= {f"{c}_{k}": (c, str(k)) for c in ("ninf", "pinf")} | {f"eps_{k}_{z}": ("eps", str(k), str(z)) for z in range(len(ZONES))} | {f"llr_{k}_{n}": ("llr", str(k), str(n)) for n in LEVELS}
    return out


def _wide_sql() -> str:
    listed = lambda n: f"coalesce(rank > 0 AND rank < {n + 1}, false)"
    cells = [f"count(*) FILTER (WHERE {listed(n)}) AS whitelisted_{n}" for n in LEVELS]
    for k in MODELS:
        e = f"e{k}"
        cells += [f"count(*) FILTER (WHERE {e} <= 0) AS ninf_{k}", f"count(*) FILTER (WHERE {e} >= 1) AS pinf_{k}"] + [f"count(*) FILTER (WHERE {e} >= {a} AND {e} < {b}) AS eps_{k}_{z}" for z, (a, b) in enumerate(ZONES)]
        cells += [f"round(coalesce(sum(ln({e} / (1 - {e}))) FILTER (WHERE {e} > 0 AND {e} < 1 AND NOT {listed(n)}), 0), 4) AS llr_{k}_{n}" for n in LEVELS]
    return f"""WITH {WIN}, pn AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, max(rank_dn) AS rank, {", ".join(f"max(eps{k}) AS e{k}" for k in MODELS)} FROM m GROUP BY ALL),
p AS (SELECT pcap_id, wnum, {", ".join(cells)} FROM pn GROUP BY ALL)
SELECT pcap_id, wnum, qr, q, r, nx, u, round(t0, 6) AS time_s_start, round(t1, 6) AS time_s_end, fn_req_min, fn_req_max, p.* EXCLUDE (pcap_id, wnum) FROM w JOIN p USING (pcap_id, wnum)"""


@query(_wide_sql())
def snk14_src9_window_table(spark, d):
    """All columns of the wide window table, written with three header rows and read again."""
    m, path, levels = full_messages(spark, d), new_path(spark) + "/wide", header_levels()
    counts = windows.count_windows(m).withColumns({c: r6(c) for c in ("time_s_start", "time_s_end")})
    profile = windows.window_profile(m)
    wide = counts.join(profile.withColumns({c: F.round(c, 4) for c in profile.columns if c.startswith("llr")}), ["pcap_id", "wnum"]).select(*levels)
    headed.write_headed(wide, path, levels)
    return headed.read_headed(spark, path, 3, ", ".join(f"`{c}` {t}" for c, t in wide.dtypes))


@query("SELECT event_id, user_id, event_type, value FROM events")
def snk12_resumed_load(spark, d):
    """Events loaded in batches by a run that fails between a batch's rows and its record, and by one that goes on."""
    path = new_path(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rows.repartition(4, "event_id").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    places = (f"{path}/rows", f"{path}/records", f"{path}/state")

    def fail(batch_id: int) -> None:
        if batch_id == 2:
            raise RuntimeError("stopped before the record")

    first = resume.start_load(stream, *places, before_record=fail)
    try:
        first.awaitTermination()
    except Exception:
        if resume.records(spark, places[1]).count() != 2:
            raise
    resume.start_load(stream, *places).awaitTermination()
    return resume.loaded(spark, *places[:2], rows.schema).drop("batch_id")


@query()
def an29_one_class_svm(spark, d):
    """Windows by the side of a one-class SVM on which they lie, fitted to those of class 0; a test holds it against a plain solver."""
    w = windows.window_profile(full_messages(spark, d)).withColumn("cls", F.col("pcap_id") % 3)
    features = [f"llr_{k}_{n}" for k in MODELS for n in (0, 50)]
    model = learning.one_class_svm(w.filter("cls = 0"), features, size=128, rounds=2)
    return learning.with_scores(w, model, features).select("pcap_id", "wnum", "cls", (F.col("decision") >= 0).alias("inside"))


@query()
def udf_scored_by_lstm(spark, d):
    """Hosts scored by an LSTM with seeded weights; a test compares plain loops over its cells."""
    return scoring.score_lstm(hosts(spark, d), scoring.Lstm.seeded(7)).select("page_id", "dn", "value", "logit")
