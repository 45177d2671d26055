"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import free_names, text_of, without

#: Labelled rows of each class that the model is fitted to at most, and the features that it has at most.
SAMPLE, FEATURES = 4000, 1024
#: What a feature's log-likelihood ratio is at least: one in a million of those that tell nothing reaches it.
EVIDENCE = 24.0
#: Severity grades: 0 clean, then 1 to GRADES - 1.
GRADES = 4
PREFIXES = (3, 4, 5, 6, 7)
WORD = re.compile(r"\w+")


def features_of(text: str | None) -> set[str]:
    """The words of a text, and beginnings of words, marked by a hyphen."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Severity:
    """P(grade <= k) = sigmoid(cuts[k] - score); the score is a sum of weights that all thresholds share."""

    weights: dict[str, float]
    cuts: list[float]

    def grades(self, score: np.ndarray) -> np.ndarray:
        """The probability of each grade, a row for each score."""
        upto = _sigmoid(np.asarray(self.cuts)[None, :] - np.asarray(score)[:, None])
        return np.diff(np.concatenate([np.zeros((len(upto), 1)), upto, np.ones((len(upto), 1))], axis=1), axis=1)

    def score(self, text: str | None) -> float:
        return sum(map(self.weights.get, self.weights.keys() & features_of(text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Severity:
    """Fits to at most `sample` labelled documents of each class, those with the least hashes of their doc_id.

    docs: (doc_id, text); labels: (doc_id, toxic). Where labels grade, toxic is 0 for clean and 1 to
    GRADES - 1 for what is the worse the higher (more counts as the highest), and these are the grades. Where they
    only say 0 or 1, a toxic document's grade is how much toxic vocabulary it has: the third that the number of
    toxic features among its own falls in. Rows with nulls, and labels without a document, take no part;
    of several labels of a document the worst counts, of several texts of one the least. Features are those that
    tell toxic from clean best (ties: in order), by the log-likelihood ratio of how many documents of each have them.
    If the sample has a larger share of one class than of the other, the cuts are moved to make up for it. Without
    both classes, or without documents, the model finds everything clean.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    drawn = [marked.filter(c).orderBy(order, "doc_id").limit(sample) for c in ("toxic = 0", "toxic > 0")]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]).withColumn("grade", F.least("toxic", F.lit(GRADES - 1))).withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).join(drawn, "doc_id")

    @F.pandas_udf("array<string>")
    def features(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sorted(features_of(t)))

    single = texts.groupBy("doc_id", "toxic", "grade").agg(F.min("text").alias("text"))
    rows = single.select("doc_id", "toxic", "grade", features("text").alias("f")).persist()
    try:
        sizes = dict(rows.groupBy("toxic").count().collect())
        if len(sizes) < 2:
            return Severity({}, [1.0 + k for k in range(GRADES - 1)])
        clean, toxic = sizes[0], sizes[1]
        counts = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
        have = F.col("t") + F.col("c")
        term = lambda n, share: F.when(n > 0, n * F.log(n / share)).otherwise(0.0)
        cells = [(F.col("t"), toxic, have), (F.col("c"), clean, have), (toxic - F.col("t"), toxic, toxic + clean - have), (clean - F.col("c"), clean, toxic + clean - have)]
        ratio = 2 * sum((term(n, size * all_ / (toxic + clean)) for n, size, all_ in cells), F.lit(0.0))
        best = counts.select("f", odds.alias("odds"), ratio.alias("ratio")).filter(F.col("ratio") >= EVIDENCE).orderBy(F.desc(F.round("ratio", 6)), "f").limit(most).collect()
        names = {r["f"]: i for i, r in enumerate(best)}
        pro = np.array([r["odds"] > 1 for r in best] or [False])
        chosen = F.broadcast(rows.sparkSession.createDataFrame([(r["f"], i) for i, r in enumerate(best)] or [("", -1)], "f string, i int"))
        held = rows.select("doc_id", "toxic", "grade", F.explode_outer("f").alias("f")).join(chosen, "f", "left").groupBy("doc_id", "toxic", "grade").agg(F.collect_list("i").alias("i")).collect()
    finally:
        rows.unpersist()
    held.sort(key=lambda r: r["doc_id"])
    lists = [np.array(sorted(r["i"]), np.int64) for r in held]
    y = np.array([r["toxic"] for r in held])
    grade = np.array([r["grade"] for r in held])
    if grade.max() == 1:
        signs = np.array([pro[x].sum() for x in lists])
        edges = np.quantile(signs[y == 1], [1 / 3, 2 / 3])
        grade = np.where(y == 0, 0, 1 + np.searchsorted(edges, signs, side="left"))
    weights, cuts = _fit_cumulative(lists, grade, len(best))
    known = dict(marked.filter("toxic >= 0").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect())
    cuts = [float(c + np.log((toxic / known[1]) / (clean / known[0]))) for c in cuts]
    return Severity({f: float(weights[i]) for f, i in names.items() if weights[i]}, cuts)


def _fit_cumulative(rows: list[np.ndarray], grade: np.ndarray, n: int, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """Maximum likelihood by Adam. Cuts stay in order as their gaps are exponentials."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, c = np.zeros(n), np.array([1.0] + [0.0] * (GRADES - 2))
    m, v = np.zeros(n + len(c)), np.zeros(n + len(c))
    for t in range(1, steps + 1):
        eta = np.bincount(at, w[col], len(rows))
        cuts = np.concatenate([[c[0]], c[0] + np.cumsum(np.exp(c[1:]))])
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = _sigmoid(ends[grade] - eta), _sigmoid(ends[grade + 1] - eta)
        p = np.maximum(high - low, 1e-12)
        dl, dh = low * (1 - low) / p, high * (1 - high) / p
        dl[grade == 0] = 0
        dh[grade == GRADES - 1] = 0
        g_eta = dh - dl  # of minus the log likelihood, by the score
        g_w = np.bincount(col, g_eta[at], n) / len(rows) + ridge * w
        g_cut = np.array([np.sum(dl[grade == k + 1]) - np.sum(dh[grade == k]) for k in range(GRADES - 1)]) / len(rows)
        g_c = np.array([g_cut.sum(), *(g_cut[k:].sum() * np.exp(c[k]) for k in range(1, GRADES - 1))])
        g = np.concatenate([g_w, g_c])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:n], c - step[n:]
    return w, np.concatenate([[c[0]], c[0] + np.cumsum(np.exp(c[1:]))]).tolist()


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """docs with `expected_severity` (0 to GRADES - 1), `severity` (the likeliest grade), `p_toxic` and `toxic` (p_toxic >= 0.5).

    Null and empty texts have no features. Whole texts are read, row by row, so repeated and very long ones need nothing
    special; of grades that are as likely the lower one counts. An empty table stays empty. Columns of docs with the
    names of new ones are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_severity: double, severity: int, p_toxic: double>")
    def graded(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in frames:
            p = model.grades(np.array([model.score(t) for t in texts]))
            yield pd.DataFrame({"expected_severity": p @ np.arange(GRADES), "severity": p.argmax(axis=1).astype(np.int32), "p_toxic": 1 - p[:, 0]})

    (found,) = free_names(docs, "graded")
    kept = without(docs, "expected_severity", "severity", "p_toxic", "toxic")
    return docs.withColumn(found, graded(text_of(F.col("text")))).select(*kept, f"{found}.*").withColumn("toxic", F.col("p_toxic") >= 0.5)
