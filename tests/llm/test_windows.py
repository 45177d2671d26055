"""op10 against all windows, on items whose parts are swapped, shifted, repeated, taken out or put in."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nxtide.llm import common, decontaminate


def best_windows(docs, items):
    """The greatest similarity of a window of each document to each item, if it is 0.8 or more: every window is tried."""
    bags = {i: (len(t.split()), Counter(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4))) for i, t in items}
    of = {}
    for i, (_, bag) in bags.items():
        for g in bag:
            of.setdefault(g, set()).add(i)
    out = {}
    for d, text in docs:
        ws = text.split()
        grams = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)]
        for i in {i for g in grams for i in of.get(g, ())}:
            n, bag = bags[i]
            for s in range(max(1, len(ws) - n + 1)):
                own = Counter(grams[s : s + n - 4])
                both = sum((own & bag).values())
                if both and both / sum((own | bag).values()) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), both / sum((own | bag).values()))
    return out


def edited(rng, ws, words):
    """The item with one kind of change."""
    n = len(ws)
    at, size = rng.randrange(n), rng.randrange(1, max(2, n // 8))
    return rng.choice([
        lambda: ws[n // 2 :] + ws[: n // 2],
        lambda: ws[at:] + ws[:at],
        lambda: ws[: n // 3] + ws[2 * n // 3 :] + ws[n // 3 : 2 * n // 3],
        lambda: ws[:at] + ws[at + size :],
        lambda: ws[:at] + rng.choices(words, k=size) + ws[at:],
        lambda: ws[:at] + ws[at : at + size] * 2 + ws[at + size :],
        lambda: ws + ws[: n // 2],
        lambda: [w if rng.random() > 0.02 else "new" for w in ws],
    ])()


def planted(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(words if i % 4 else words[:6], k=rng.randrange(5, 120)))) for i in range(24)]
    docs = []
    for d in range(n):
        other = [rng.choices(words, k=rng.choice([0, 0, 2, 3, 40, 100])) for _ in range(2)]
        docs.append((d, " ".join(other[0] + edited(rng, rng.choice(items)[1].split(), words) + other[1])))
    docs.append((n, " ".join(items[1][1].split() * 40)))
    return docs, items


@pytest.mark.parametrize("send, spread", [(decontaminate.BROADCAST_ROWS, 1000), (0, 2)])
def test_no_window_is_missed(spark, monkeypatch, send, spread):
    monkeypatch.setattr(common, "SPREAD_ROWS", spread)
    docs, items = planted(send % 7, 1500)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, bench, send_rows=send).collect()}
    want = best_windows(docs, items)
    assert got.keys() == want.keys() and len(want) > 700
    assert all(abs(got[k]["similarity"] - s) < 1e-9 for k, s in want.items())


def test_swapped_halves_in_a_long_text(spark):
    item = [f"i{k}" for k in range(60)]
    other = lambda c, n: [f"{c}{k}" for k in range(n)]
    docs = [(0, other("a", 100) + item[30:] + item[:30] + other("b", 100)), (1, other("a", 3) + item[30:] + item[:30] + other("b", 2))]
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert [(rows[d]["start_word"], round(rows[d]["similarity"], 3)) for d in (0, 1)] == [(100, 0.867), (3, 0.867)]


def test_shorter_texts_and_other_similarities(spark):
    item = [f"i{k}" for k in range(40)]
    docs = spark.createDataFrame([(n, " ".join(item[:n])) for n in range(1, 41)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for similarity in (0.5, 0.8, 0.95):
        got = {r["doc_id"] for r in decontaminate.leaks(docs, bench, radius=64, segments=64, similarity=similarity).collect()}
        assert got == {n for n in range(5, 41) if (n - 4) / 36 >= similarity}
    assert decontaminate.leaks(docs.withColumn("start_word", F.lit(1)).withColumn("need", F.lit("x")), bench).count() == sum((n - 4) / 36 >= 0.8 for n in range(41))
