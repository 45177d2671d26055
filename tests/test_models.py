"""The LSTM against loops over its cells, the one-class SVM against a plain solver, forward selection on planted features."""

import io
import math
import random

import numpy as np

from nxtide.functions.domains import VOCABULARY
from nxtide.operators import learning, scoring
from nxtide.plans import registry


def plain_lstm(m, name, size=60):
    text = ".".join(reversed(name.lower().split(".")))[:size]
    ids = [VOCABULARY.find(c) + 1 for c in text] + [0] * (size - len(text))
    n = len(m.dense)
    h, c = [0.0] * n, [0.0] * n
    sig = lambda x: 1 / (1 + math.exp(-x))
    for i in ids:
        gates = [m.bias[g] + sum(e * m.kernel[k][g] for k, e in enumerate(m.embedding[i])) + sum(h[k] * m.recurrent[k][g] for k in range(n)) for g in range(4 * n)]
        c = [sig(gates[n + j]) * c[j] + sig(gates[j]) * math.tanh(gates[2 * n + j]) for j in range(n)]
        h = [sig(gates[3 * n + j]) * math.tanh(c[j]) for j in range(n)]
    return sig(sum(a * b for a, b in zip(h, m.dense)) + m.dense_bias)


def test_lstm_equals_plain_cells(spark):
    model = scoring.Lstm.seeded(3, embedding=4, hidden=5)
    names = ["a.com", "xn--q9.example.org", "", "UPPER.Net", "é!.x", "a" * 90 + ".b", None, "a.com"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, dn string")
    out = {r["id"]: r for r in scoring.score_lstm(df, model, batch=3).collect()}
    assert len(out) == len(names) and out[6]["value"] is None
    assert all(math.isclose(out[i]["value"], plain_lstm(model, n), abs_tol=1e-12) for i, n in enumerate(names) if n is not None)
    assert math.isclose(out[0]["logit"], math.log(out[0]["value"] / (1 - out[0]["value"])))
    held = io.BytesIO()
    np.savez(held, **model.__dict__)
    held.seek(0)
    assert np.array_equal(scoring.Lstm.from_file(held).predict(np.arange(60)[None, :] % 39), model.predict(np.arange(60)[None, :] % 39))


def test_query_of_scored_hosts(spark, tiny):
    model = scoring.Lstm.seeded(7)
    rows = registry.queries()["udf_scored_by_lstm"](spark, tiny).collect()
    some = {r["dn"]: r["value"] for r in rows}
    assert all(math.isclose(some[n], plain_lstm(model, n), abs_tol=1e-9) for n in sorted(some)[:2])


def plain_svm(x, nu, model):
    """Weights and rho of the same problem by a long subgradient descent over all rows at once."""
    z = learning.features_of(x, model.directions, model.phases)
    w, most = np.zeros(z.shape[1]), math.ceil(nu * len(z))
    for t in range(6000):
        low = np.argsort(z @ w, kind="stable")[:most]
        w += (z[low].mean(axis=0) - w) / (t + 1)
    return w, np.sort(z @ w)[most - 1]


def test_one_class_svm_equals_a_plain_solver(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1200, 3)), rng.normal(size=(800, 3)) * 0.5 + 4])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    model = learning.one_class_svm(df, ["a", "b", "c"], nu=0.1, rows_in_part=500)
    w, rho = plain_svm(x, 0.1, model)
    got = {r["id"]: r["decision"] >= 0 for r in learning.with_scores(df, model, ["a", "b", "c"]).collect()}
    want = learning.features_of(x, model.directions, model.phases) @ w >= rho
    assert np.mean([got[i] == want[i] for i in range(len(x))]) >= 0.99
    assert 0.08 <= 1 - np.mean(list(got.values())) <= 0.12
    far = spark.createDataFrame([(1, 40.0, -40.0, 9.0), (2, 4.0, 4.0, 4.0), (3, None, 1.0, 1.0)], "id long, a double, b double, c double")
    side = {r["id"]: r["decision"] for r in learning.with_scores(far, model, ["a", "b", "c"]).collect()}
    assert side[1] < 0 < side[2] and side[3] is None


def test_forward_selection_finds_planted_features(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, noise = rng.random(), rng.random(), rng.random()
        rows.append((i, int(a + 0.6 * b > 0.8), a, b, noise, 1.0))
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, noise double, still double")
    features = learning.varied(df, ["a", "b", "noise", "still"])
    assert features == ["a", "b", "noise"]
    assert learning.forward_selection(df, "y", features, 2, k=2, trees=5) == ["a", "b"]
