"""Queries that allocate thresholds, choose them on training folds, and say how wrong each one is."""

from __future__ import annotations

from pyspark.sql import functions as F

from nxtide.operators import search, windows
from nxtide.operators.scratch import save
from nxtide.plans.registry import query
from nxtide.plans.relational import GRID_SQL, grid, r6
from nxtide.plans.star import FULL, full_messages

REDUCER, PARTS = 10, 4

APPLIED = f"""{FULL}, w AS (SELECT pcap_id, fn_req // 50 AS wnum, dn_id, count(*) AS qr, count(*) FILTER (WHERE NOT is_r) AS q, count(*) FILTER (WHERE is_r) AS r, max(eps1) AS e, max(rank_dn) AS rank FROM m GROUP BY ALL), {GRID_SQL},
lr AS (SELECT pcap_id, wnum, cfg, pcap_id % 3 AS cls, CAST(floor(round(sum((CASE WHEN rank > 0 AND rank < wl_rank THEN wl_value WHEN e >= 1 THEN pinf WHEN e <= 0 THEN ninf ELSE ln(e / (1 - e)) END)
  * (CASE WHEN uniq THEN 1 WHEN packet = 'q' THEN q WHEN packet = 'r' THEN r ELSE qr END)), 6)) AS BIGINT) AS v FROM w, g GROUP BY pcap_id, wnum, cfg),
rd AS (SELECT v - v % {REDUCER} AS r FROM lr), en AS (SELECT min(r) AS lo, max(r) + {REDUCER} AS hi, count(*) AS total FROM rd), es AS (SELECT lo, total, greatest((hi - lo) // 50, 1) AS step FROM en),
bl AS (SELECT least((r - lo) // step, 49) AS block, count(*) AS n FROM rd, es GROUP BY ALL),
sp AS (SELECT b.block, coalesce(n, 0) AS n, CASE WHEN b.block < 50 AND n > 0 THEN CAST(ceil(n / total * 200) AS BIGINT) ELSE 1 END AS held, lo, step FROM (SELECT unnest(range(51)) AS block) b LEFT JOIN bl ON bl.block = b.block, es),
th AS (SELECT block, k, n, CAST(lo + step * block + step // held * k AS BIGINT) AS th FROM (SELECT *, unnest(range(held)) AS k FROM sp)), tt AS (SELECT DISTINCT th FROM th)"""


def _applied(spark, d):
    """(pcap_id, wnum, cfg, cls, llr) of all windows under all configurations, as a table."""
    return save(windows.apply_configs(full_messages(spark, d), grid(spark)).select("pcap_id", "wnum", "cfg", (F.col("pcap_id") % 3).alias("cls"), "llr"))


def _thresholds(applied):
    return search.allocated_thresholds(applied.select(search.whole(F.col("llr")).alias("v")), reducer=REDUCER)


def _listed(applied):
    """The thresholds on the driver: 301 at most."""
    return [r["th"] for r in _thresholds(applied).collect()]


@query(f"WITH {APPLIED} SELECT block, k, n, th FROM th")
def agg33_allocated_thresholds(spark, d):
    return _thresholds(_applied(spark, d))


def _chosen_sql(name: str, score: str, greater: bool) -> str:
    return f"SELECT cfg, turn, '{name}' AS chooser, th, tp, fp, tn, fn, {score} AS score FROM tried QUALIFY row_number() OVER (PARTITION BY cfg, turn ORDER BY {score} {'DESC' if greater else 'ASC'} NULLS LAST, th) = 1"


SCORES = {"f1": ("2 * tp / nullif(2 * tp + fp + fn, 0)", True), "fpr": ("fp / nullif(fp + tn, 0)", False), "tpr": ("tp / nullif(tp + fn, 0)", True)}


@query(f"""WITH {APPLIED}, ws AS (SELECT DISTINCT pcap_id, wnum, cls FROM lr), po AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY pcap_id, wnum) - 1 AS rn, count(*) OVER (PARTITION BY cls) AS n FROM ws),
fo AS (SELECT pcap_id, wnum, least(rn // greatest(n // {PARTS}, 1), {PARTS - 1}) AS fold FROM po),
tu AS (SELECT cfg, cls, v, turn, (fold - turn + {PARTS}) % {PARTS} >= 1 AS train FROM lr JOIN fo USING (pcap_id, wnum), (SELECT unnest(range({PARTS})) AS turn)),
ce AS (SELECT cfg, turn, train, th, count(*) FILTER (WHERE cls > 0 AND v >= th) AS tp, count(*) FILTER (WHERE cls = 0 AND v >= th) AS fp, count(*) FILTER (WHERE cls = 0 AND v < th) AS tn, count(*) FILTER (WHERE cls > 0 AND v < th) AS fn FROM tu, tt GROUP BY ALL),
rg AS (SELECT cfg, turn, min(v - v % {REDUCER}) AS lo, max(v - v % {REDUCER}) AS hi FROM tu WHERE train GROUP BY ALL),
tried AS (SELECT ce.* FROM ce JOIN rg USING (cfg, turn) WHERE train AND th >= coalesce((SELECT max(th) FROM tt WHERE th <= lo), (SELECT min(th) FROM tt)) AND th <= coalesce((SELECT max(th) FROM tt WHERE th <= hi), (SELECT min(th) FROM tt))),
ch AS ({" UNION ALL ".join("(" + _chosen_sql(n, s, g) + ")" for n, (s, g) in SCORES.items())})
SELECT ch.cfg, ch.turn, chooser, ch.th, ch.tp AS train_tp, ch.fp AS train_fp, ch.tn AS train_tn, ch.fn AS train_fn, t.tp AS test_tp, t.fp AS test_fp, t.tn AS test_tn, t.fn AS test_fn, round(score, 6) AS train_score,
  round(CASE chooser {" ".join(f"WHEN '{n}' THEN " + s.replace("tp", "t.tp").replace("fp", "t.fp").replace("tn", "t.tn").replace("fn", "t.fn") for n, (s, _) in SCORES.items())} END, 6) AS test_score
FROM ch LEFT JOIN ce t ON t.cfg = ch.cfg AND t.turn = ch.turn AND t.th = ch.th AND NOT t.train""")
def an10_threshold_search(spark, d):
    applied = _applied(spark, d)
    folds = windows.split_portion(applied.select("pcap_id", "wnum", "cls").distinct(), 0, PARTS).select("pcap_id", "wnum", "fold")
    out = search.threshold_search(applied.join(folds, ["pcap_id", "wnum"]), _listed(applied), PARTS, reducer=REDUCER)
    return out.withColumns({c: r6(c) for c in ("train_score", "test_score")})


@query(f"""WITH {APPLIED}, wr AS (SELECT cfg, cls, th, avg(CASE WHEN (v >= th) = (cls > 0) THEN 0 ELSE 1 END) AS wrong FROM lr, tt GROUP BY ALL)
SELECT cfg, cls, quarter, round(avg(CASE WHEN least(floor(wrong * 4), 3) = quarter THEN 1 ELSE 0 END), 6) AS share FROM wr, (SELECT unnest(range(4)) AS quarter) GROUP BY ALL""")
def an11_threshold_ranges(spark, d):
    applied = _applied(spark, d)
    return search.threshold_ranges(search.threshold_table(applied, _listed(applied))).withColumn("share", r6("share"))
