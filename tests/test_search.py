"""Allocated thresholds and the search for the best one against plain loops."""

import math
import random

import pytest

from nxtide.operators import search

CELLS = ("tp", "fp", "tn", "fn")


def cut(v, reducer):
    return int(v / reducer) * reducer


def plain_thresholds(values, blocks, most, reducer):
    cuts = [cut(v, reducer) for v in values]
    lo, hi = min(cuts), max(cuts) + reducer
    step = max((hi - lo) // blocks, 1)
    held = [0] * blocks
    for v in cuts:
        held[min((v - lo) // step, blocks - 1)] += 1
    out = []
    for b, n in enumerate(held):
        here = math.ceil(n / len(values) * most) if n else 1
        out += [(b, k, n, lo + step * b + step // here * k) for k in range(here)]
    return [*out, (blocks, 0, 0, lo + step * blocks)]


@pytest.mark.parametrize("blocks, most, reducer, spread", [(50, 200, 100, 9000), (4, 9, 3, 40), (5, 12, 10, 3), (50, 200, 1, 20)])
def test_allocated_thresholds(spark, blocks, most, reducer, spread):
    rng = random.Random(blocks + spread)
    values = [int(rng.gauss(-spread / 3, spread)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    got = sorted(tuple(r) for r in search.allocated_thresholds(df, blocks, most, reducer).collect())
    assert got == sorted(plain_thresholds(values, blocks, most, reducer)) and len(got) <= most + 2 * blocks + 1
    assert search.allocated_thresholds(df.filter("v is null"), blocks, most, reducer).count() == 0
    with pytest.raises(ValueError):
        search.allocated_thresholds(df, 50, 99)


def measures(tp, fp, tn, fn):
    share = lambda a, b: a / b if b else None
    return {"f1": share(2 * tp, 2 * tp + fp + fn), "fpr": share(fp, fp + tn), "tpr": share(tp, tp + fn), "accuracy": share(tp + tn, tp + fp + tn + fn)}


def confusion(rows, th):
    return (sum(c > 0 and v >= th for c, v in rows), sum(c == 0 and v >= th for c, v in rows), sum(c == 0 and v < th for c, v in rows), sum(c > 0 and v < th for c, v in rows))


@pytest.mark.parametrize("test", [1, 2])
def test_search_equals_plain_loops(spark, test):
    rng = random.Random(test)
    rows = [(cfg, rng.choice([0, 0, 1, 2]), fold, rng.uniform(-60, 40) + cfg) for cfg in range(3) for fold in range(4) for _ in range(12)] + [(7, 0, f, -5.0) for f in range(4)]
    ths = [-50, -20, -20, -7, 0, 3, 11, 30]
    df = spark.createDataFrame([*rows, (0, 1, 2, None)], "cfg long, cls long, fold long, llr double")
    got = {(r["cfg"], r["turn"], r["chooser"]): r for r in search.threshold_search(df, ths, 4, test, 10, tuple(search.CHOOSERS)).collect()}
    tried = sorted(set(ths))
    below = lambda v: max([t for t in tried if t <= v], default=tried[0])
    for cfg in {r[0] for r in rows}:
        for turn in range(4):
            own = [(c, math.floor(v), (f - turn) % 4 >= test) for g, c, f, v in rows if g == cfg]
            train, rest = [r[:2] for r in own if r[2]], [r[:2] for r in own if not r[2]]
            cuts = [cut(v, 10) for _, v in train]
            for name, (_, greater) in search.CHOOSERS.items():
                best = None
                for th in (t for t in tried if below(min(cuts)) <= t <= below(max(cuts))):
                    score = measures(*confusion(train, th))[name]
                    rank = -math.inf if score is None else score if greater else -score
                    if best is None or rank > best[0]:
                        best = (rank, th, score)
                r = got.pop((cfg, turn, name))
                assert r["th"] == best[1] and (r["train_score"] is None) == (best[2] is None) and math.isclose(r["train_score"] or 0, best[2] or 0)
                assert tuple(r[f"train_{c}"] for c in CELLS) == confusion(train, r["th"]) and tuple(r[f"test_{c}"] for c in CELLS) == confusion(rest, r["th"])
                want = measures(*confusion(rest, r["th"]))[name]
                assert (r["test_score"] is None) == (want is None) and math.isclose(r["test_score"] or 0, want or 0)
    assert not got
    assert search.threshold_search(df.limit(0), ths, 4).count() == 0


def test_table_and_ranges(spark):
    rng = random.Random(5)
    rows = [(1, rng.choice([0, 1]), rng.uniform(-9, 9)) for _ in range(60)]
    ths = list(range(-10, 11, 2))
    table = search.threshold_table(spark.createDataFrame(rows, "cfg long, cls long, llr double"), ths)
    wrong = {(r["cls"], r["th"]): r["wrong"] for r in table.collect()}
    for cls in (0, 1):
        own = [math.floor(v) for _, c, v in rows if c == cls]
        assert all(math.isclose(wrong[cls, t], sum((v >= t) != (cls > 0) for v in own) / len(own)) for t in ths)
    shares = {(r["cls"], r["quarter"]): r["share"] for r in search.threshold_ranges(table).collect()}
    for cls in (0, 1):
        for q in range(4):
            assert math.isclose(shares[cls, q], sum(min(int(wrong[cls, t] * 4), 3) == q for t in ths) / len(ths))
