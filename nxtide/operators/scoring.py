"""Scores of domain names by pluggable models: each distinct name once, in Arrow batches, joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.functions.domains import VOCABULARY, encoded
from nxtide.functions.packets import logit


def stand_in() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic model in place of trained weights: a logistic of a fixed projection of the encoded name."""
    at = np.cos(np.arange(60))

    def predict(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ at) / 40))

    return predict


def score(names: DataFrame, column: str = "dn", load: Callable[[], Callable[[np.ndarray], np.ndarray]] = stand_in, size: int = 60, batch: int = 128) -> DataFrame:
    """names with `value` and `logit`. load() runs once in a worker and returns a function from id matrices to probabilities."""

    @F.pandas_udf("double")
    def predicted(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for column in frames:
            x = np.stack(column.to_numpy()) if len(column) else np.empty((0, size))
            yield pd.Series(np.concatenate([model(x[i : i + batch]) for i in range(0, len(x), batch)]) if len(x) else [])

    own = names.select(column).filter(F.col(column).isNotNull()).distinct()
    scored = own.withColumn("value", predicted(encoded(F.col(column), size))).withColumn("logit", logit(F.col("value")))
    return names.join(scored, column, "left")


def unscored(names: DataFrame, scores: DataFrame, model: int) -> DataFrame:
    """Names (dn_id) that have no score of a model yet."""
    return names.join(scores.filter(F.col("nn_id") == model).select("dn_id"), "dn_id", "left_anti")


@dataclass(frozen=True)
class Lstm:
    """A recurrent scorer: an embedding of the name's ids, one LSTM layer, and the logistic of a weighted sum of its last output.

    embedding: (ids, e); kernel: (e, 4h) and recurrent: (h, 4h), with the gates in the order input, forget, candidate, output; bias: (4h,);
    dense: (h,), and its bias.
    """

    embedding: np.ndarray
    kernel: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float

    @classmethod
    def seeded(cls, seed: int, embedding: int = 16, hidden: int = 32) -> Lstm:
        """Weights drawn from a seed: what has the shape of a trained model, where none is at hand."""
        rng, ids = np.random.default_rng(seed), len(VOCABULARY) + 1
        draw = lambda *shape: rng.normal(scale=1 / np.sqrt(shape[0]), size=shape)
        return cls(rng.normal(size=(ids, embedding)), draw(embedding, 4 * hidden), draw(hidden, 4 * hidden), draw(1, 4 * hidden)[0], draw(hidden), float(draw(1)[0]))

    @classmethod
    def from_file(cls, file) -> Lstm:
        """Weights saved by np.savez under the names of the fields; file: a path on the driver or an open file."""
        held = np.load(file)
        return cls(**{f.name: float(held[f.name]) if f.name == "dense_bias" else held[f.name] for f in fields(cls)})

    def predict(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of a matrix of ids, a row for each name: one matrix step for each place, for all names at once."""
        hidden = self.recurrent.shape[0]
        h, c = np.zeros((len(ids), hidden)), np.zeros((len(ids), hidden))
        steps = self.embedding @ self.kernel + self.bias  # what each id adds to the gates
        for place in range(ids.shape[1]):
            i, f, g, o = np.split(steps[ids[:, place]] + h @ self.recurrent, 4, axis=1)
            c = _logistic(f) * c + _logistic(i) * np.tanh(g)
            h = _logistic(o) * np.tanh(c)
        return _logistic(h @ self.dense + self.dense_bias)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def score_lstm(names: DataFrame, model: Lstm, column: str = "dn", size: int = 60, batch: int = 1024) -> DataFrame:
    """names with `value` and `logit` by an LSTM, whose weights each executor gets once. Null names have none; each distinct name is scored once."""
    sent = names.sparkSession.sparkContext.broadcast(model)
    return score(names, column, lambda: sent.value.predict, size, batch)
