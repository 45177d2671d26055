"""op12: outputs against a plain version, and texts rebuilt from them."""

import hashlib
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same  # noqa: E402

from nxtide.llm import fill_middle, queries  # noqa: E402

ODD = ["a", "B", "\x01", "\x02", "\x03", "\x04", "$", "$0", "\\", "<", "P>", "S>", "M", ">", "\n", "\r", "é", "😀", "foo", "<S", "ź", "\x00", " ", "1", "ſ", "K"]


def plain(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("seed", [1, 77])
def test_outputs_and_texts_rebuilt(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randrange(0, 14)))) for i in range(2000)]
    rows += [(None, "x y"), (None, None), (5001, None), (5002, ""), (-3, "  abc \x85"), (7, "twice"), (7, "twice"), (9000, "ab " * 200_000), (9001, "a" * 500_000)]
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), seed)
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(d, t, seed) for d, t in rows), key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark, tiny):
    same(spark, tiny, queries.op12_fill_middle, queries.OP12_SQL)


def test_rates_clashing_columns_and_empty_tables(spark):
    names = "n form prefix_chars middle_chars output _text _marked _units _a _b _h3 _head _prefix _suffix".split()
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words, and more").alias("text"), *(F.lit(f"own {c}").alias(c) for c in names))
    out = fill_middle.transform(docs, percent=50, suffix_first=30)
    assert len(out.columns) == len(set(out.columns)) and out.filter("_marked <> 'own _marked' or _a <> 'own _a' or form = 'own form'").count() == 0
    forms = {r["form"]: r["count"] for r in out.groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 230 < forms["spm"] < 370
    assert fill_middle.transform(docs, percent=100).filter("form = 'plain'").count() == 0
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_no_python_workers(spark, tiny):
    plan = queries.op12_fill_middle(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
