"""op11: code lengths against a plain model, accuracy held out, odd rows."""

import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from nxtide.llm import language, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string"


class Plain:
    """A context tree in dictionaries: a byte at a time."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            data = bytes([language.START]) * language.ORDER + t.encode()
            for i in range(language.ORDER, len(data)):
                for k in range(language.ORDER + 1):
                    self.after[data[i - k : i]][data[i]] += 1
        self.n = {c: sum(seen.values()) + len(seen) for c, seen in self.after.items()}

    def bits(self, text):
        data, total = bytes([language.START]) * language.ORDER + text.encode(), 0.0
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER, -1, -1):
                seen = self.after.get(data[i - k : i])
                if not seen:
                    continue
                n = self.n[data[i - k : i]]
                if data[i] in seen:
                    total += math.log2(n / seen[data[i]])
                    break
                total += math.log2(n / len(seen))
            else:
                total += 8
        return total


def sample_rows(seed):
    rng = random.Random(seed)
    letters = {"aa": "abcde é", "bb": "bcdfg ñ", "cc": "xyzw 日"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randrange(1, 60))), lang) for i, lang in enumerate(rng.choices(list(letters), k=90))]
    return rows + [(200, rows[0][1], rows[0][2]), (201, None, "aa"), (202, "abc", None), (203, "", "bb")]


@pytest.mark.parametrize("coded", [language.CODED, 1])
def test_code_lengths_equal_a_plain_model(spark, monkeypatch, coded):
    monkeypatch.setattr(language, "CODED", coded)  # with 1: stretches of 1,024 bytes
    rows = sample_rows(1)
    model = language.fit(spark.createDataFrame(rows, DOCS))
    plain = {x: Plain({t for _, t, lang in rows if lang == x and t}) for x in model.names}
    assert model.names == ["aa", "bb", "cc"]
    asked = ["abc de", "", "日", "q", "xyz" * 2000, "\n\n\n\n", "", *(t for _, t, _ in rows[:40]), "\x00é" * 900, ""]
    got = model.lengths([t.encode() for t in asked], model.prepare())
    assert np.allclose(got, [[plain[x].bits(t) for x in model.names] for t in asked], rtol=1e-9, atol=1e-6)


def test_query_equals_a_plain_model(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    names = sorted({r["lang"] for r in rows if r["lang"] and r["text"] and not held[r["doc_id"]]})
    plain = {x: Plain({r["text"] for r in rows if r["lang"] == x and r["text"] and not held[r["doc_id"]]}) for x in names}
    texts, want = {r["doc_id"]: r["text"] for r in rows}, {}
    got = {r["doc_id"]: r for r in queries.op11_language_id(spark, tiny).collect()}
    assert got.keys() == texts.keys() and all(r["held_out"] == held[d] for d, r in got.items())
    for d in list(texts)[::7]:
        t = texts[d]
        want[d] = min(names, key=lambda x: plain[x].bits(t)) if t and re.search(r"[^\W\d_]", t) else "und"
    assert {d: got[d]["lang_pred"] for d in want} == want
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op11_language_id(spark, sf).join(truth, "doc_id").filter("held_out").groupBy((F.col("lang") == F.col("lang_pred")).alias("right")).count().collect()
    counts = {r["right"]: r["count"] for r in out}
    assert counts[True] >= 0.99 * sum(counts.values()) and sum(counts.values()) > 1500


def test_sample_is_bounded_and_each_language_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abc é", k=400)), "aa") for i in range(400)] + [(1000, "xyz" * 5000, "long")] + [(2000 + i, "the same", "copies") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, DOCS), language_bytes=4000)
    trees = dict(zip(model.names, range(3)))
    assert set(trees) == {"aa", "copies", "long"}
    seen = np.isfinite(model.codes[0]) & (model.codes[0] < 8)
    assert seen.any(axis=0).all()
    one = language.Languages.of({"copies": language.counted([b"the same"])})
    tables = one.prepare()
    at = model.names.index("copies")
    assert np.allclose(model.lengths([b"the same"], model.prepare())[0, at], one.lengths([b"the same"], tables)[0, 0])  # copies count once
    with pytest.raises(ValueError):
        language.fit(spark.range(1100).select(F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


def test_odd_rows(spark):
    rows = sample_rows(2)
    model = language.fit(spark.createDataFrame(rows, DOCS))
    odd = [(None, "abc", None), (1, None, "aa"), (2, "", "aa"), (3, " 12.5\n", "aa"), (4, "日", None), (5, "abcde " * 300_000, None), (6, "twice abc", None), (6, "twice abc", None)]
    df = spark.createDataFrame(odd, DOCS).withColumns({c: F.lit(f"own {c}") for c in ("lang_pred", "score", "_text", "x")})
    out = language.predict(df, model).collect()
    assert len(out) == len(odd) and all(r["_text"] == "own _text" and r["x"] == "own x" for r in out)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "cc" and by[5][0] == "aa" and by[None][0] == "aa"
    assert language.predict(df.limit(0), model).count() == 0
    assert language.fit(df.limit(0)) is None and language.fit(df.filter("doc_id = 1")) is None
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df, None).collect()} == {("und", 0.0)}
    even = language.Languages.of({"zz": language.counted([b"ab"]), "mm": language.counted([b"ab"])})
    tied = language.predict(spark.createDataFrame([(1, "abab", None)], DOCS), even).first()
    assert tied["lang_pred"] == "mm" and tied["score"] == 0.5
