"""Supervised models over features of windows or captures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, pi

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.operators.messages import running_rank
from nxtide.operators.scratch import save


def varied(df: DataFrame, features: list[str], threshold: float = 0.0) -> list[str]:
    """The features whose variance is over a threshold."""
    model = VarianceThresholdSelector(varianceThreshold=threshold, featuresCol="_v", outputCol="_s").fit(VectorAssembler(inputCols=features, outputCol="_v").transform(df))
    return [features[i] for i in model.selectedFeatures]


def stratified_folds(df: DataFrame, label: str, k: int, identity: str) -> DataFrame:
    """df with fold, in which each class has an equal share; the order is a hash of a row's identity."""
    place = running_rank(df.withColumn("_order", F.xxhash64(identity)), (label,), F.shiftright("_order", 52), ("_order", identity), "_place")
    return place.select(*df.columns, (F.col("_place") % k).alias("fold"))


def cross_validated(df: DataFrame, label: str, features: list[str], k: int = 5, identity: str = "id", trees: int = 20, seed: int = 1) -> DataFrame:
    """Rows with the prediction and probability of a forest fitted to the other folds."""
    data = VectorAssembler(inputCols=features, outputCol="_v").transform(stratified_folds(df, label, k, identity)).withColumn("_y", F.col(label).cast("double"))
    data = save(data)  # each fold's fit and prediction read it again
    out = None
    for fold in range(k):
        model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(data.filter(F.col("fold") != fold))
        part = model.transform(data.filter(F.col("fold") == fold)).select(*df.columns, "fold", "prediction", "rawPrediction")
        out = part if out is None else out.unionByName(part)
    return out


def area(predicted: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol="_y").evaluate(predicted.withColumn("_y", F.col(label).cast("double")))


def forward_selection(df: DataFrame, label: str, features: list[str], most: int, **options) -> list[str]:
    """Features added one by one, each time the one with the best cross-validated area."""
    chosen: list[str] = []
    while len(chosen) < min(most, len(features)):
        chosen.append(max((f for f in features if f not in chosen), key=lambda f: (area(cross_validated(df, label, [*chosen, f], **options), label), f)))
    return chosen


def one_class(train: DataFrame, features: list[str], share: float = 0.05) -> tuple[DataFrame, float]:
    """(mean and deviation of each feature, limit): a normal profile, and the distance that a share of the training rows exceeds."""
    profile = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features))
    limit = distance(train, profile, features).agg(F.percentile("distance", 1 - share)).first()[0]
    return profile, limit


def distance(df: DataFrame, profile: DataFrame, features: list[str]) -> DataFrame:
    parts = [F.pow(F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")), F.lit(0.0)), F.lit(2)) for f in features]
    return df.crossJoin(F.broadcast(profile)).withColumn("distance", F.sqrt(sum(parts, F.lit(0.0)))).select(*df.columns, "distance")


@dataclass(frozen=True)
class OneClass:
    """A one-class ν-SVM with a Gaussian kernel by random Fourier features: a row is inside where weights . features(x) >= rho."""

    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float

    @staticmethod
    def space(columns: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        return rng.normal(scale=np.sqrt(2 * gamma), size=(columns, size)), rng.uniform(0, 2 * pi, size)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return features_of(x, self.directions, self.phases) @ self.weights


def features_of(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)


def descend(z: np.ndarray, nu: float, weights: np.ndarray, begin: int, steps: int) -> np.ndarray:
    """Subgradient steps on |w|^2 / 2 - the mean of the least nu-share of scores w . z: what is left of the ν-SVM's loss at its best rho.

    With a step of 1 / t the weights are the mean of the features that were lowest so far.
    """
    most = max(1, ceil(nu * len(z)))
    for t in range(begin, begin + steps):
        low = np.argpartition(z @ weights, most - 1)[:most]
        weights = weights + (z[low].mean(axis=0) - weights) / (t + 1)
    return weights


def one_class_svm(train: DataFrame, features: list[str], nu: float = 0.05, gamma: float | None = None, size: int = 256, rounds: int = 4, steps: int = 200, rows_in_part: int = 50_000, seed: int = 1) -> OneClass:
    """Fits a one-class ν-SVM: about nu of the training rows lie outside.

    Rows are dealt at random to parts of `rows_in_part`, each of which goes its subgradient steps in a task; after each
    round the mean of the parts' weights, by their rows, is where all go on. gamma: 1 over the number of features times the variance of
    their values, if not given. rho is the nu-quantile of all rows' scores. Rows with a null or non-finite feature take
    no part. Without rows the fit fails.
    """
    finite = [F.col(f).cast("double").isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")) for f in features]
    rows = train.select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), _all(finite).alias("ok")).filter("ok").drop("ok")
    values = rows.select(F.explode(F.array(*rows.columns)).alias("v")).agg(F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("n")).first()
    n = values["n"] // max(1, len(features))
    if not n:
        raise ValueError("no rows to fit")
    gamma = gamma or 1 / (len(features) * values["v"] if values["v"] else 1.0)
    parts = max(1, ceil(n / rows_in_part))
    dealt = save(rows.withColumn("part", F.floor(F.rand(seed) * parts).cast("int")))
    directions, phases = OneClass.space(len(features), gamma, size, seed)
    weights, sc = np.zeros(size), train.sparkSession.sparkContext
    for k in range(rounds):
        sent = sc.broadcast((directions, phases, weights))
        found = dealt.groupBy("part").applyInPandas(_round(sent, nu, k * steps, steps), "n long, w array<double>")
        at = found.select("n", F.posexplode("w").alias("i", "w")).groupBy("i").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).collect()  # `size` rows
        weights = np.array([r["w"] for r in sorted(at, key=lambda r: r["i"])])
        sent.unpersist()
    model = OneClass(directions, phases, weights, 0.0)
    scored = with_scores(dealt, model, [f"x{i}" for i in range(len(features))], "score")
    rho = scored.agg(F.percentile_approx("score", nu, 100_000)).first()[0]
    return OneClass(directions, phases, weights, float(rho))


def _round(sent, nu: float, begin: int, steps: int):
    """The steps of a round over one part, from weights that were sent to all."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        directions, phases, weights = sent.value
        z = features_of(frame.drop(columns="part").to_numpy(float), directions, phases)
        return pd.DataFrame({"n": [len(z)], "w": [descend(z, nu, weights, begin, steps).tolist()]})

    return run


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_scores(df: DataFrame, model: OneClass, features: list[str], name: str = "decision") -> DataFrame:
    """df with the model's decision: 0 or more inside, less outside; null where a feature is null."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def decided(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for column in frames:
            yield pd.Series(model.scores(np.stack(column.to_numpy())) - model.rho if len(column) else [], dtype=float)

    held = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    return df.withColumn(name, F.when(_all([F.col(f).isNotNull() for f in features]), decided(held)))
