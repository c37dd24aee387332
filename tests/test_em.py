"""The model protocol: a hidden Markov model and a model of the test's own."""

import numpy as np
import pyarrow as pa
import pytest

from stemma.operators import em


def test_hidden_markov_rates_are_found(spark):
    rng = np.random.default_rng(1)
    start, moves, shown = np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.8, 0.15, 0.05], [0.05, 0.15, 0.8]])
    rows = [(-1, None), (-2, [])]
    for k in range(300):
        s, xs = rng.choice(2, p=start), []
        for _ in range(rng.integers(1, 60)):
            xs.append(int(rng.choice(3, p=shown[s])))
            s = rng.choice(2, p=moves[s])
        rows.append((k, xs))
    df = spark.createDataFrame(rows, "key long, xs array<int>").repartition(3)
    first = (np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.4, 0.6]]), np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]))
    (s, m, e), trace = em.fit(df, em.HiddenMarkov(2, 3), first, iterations=60, rel_tol=1e-7)
    assert (np.diff(trace) >= -1e-6).all() and 3 < len(trace) <= 60
    np.testing.assert_allclose(m, moves, atol=0.06)
    np.testing.assert_allclose(e, shown, atol=0.06)
    _, stopped = em.fit(df, em.HiddenMarkov(2, 3), first, iterations=60, rel_tol=1e-2)
    assert len(stopped) < len(trace)
    again, none = em.fit(df.where("key > 1000"), em.HiddenMarkov(2, 3), first)
    assert again is first and none == []


class Coins:
    """Two coins, each row (heads, throws) being throws of one of them."""

    columns = ["heads", "throws"]

    def expect(self, parameters, batch: pa.RecordBatch) -> np.ndarray:
        h, n = (batch.column(k).to_numpy().astype(float) for k in range(2))
        weight, p = parameters
        logs = np.log(weight)[:, None] + h * np.log(p)[:, None] + (n - h) * np.log(1 - p)[:, None]
        top = logs.max(0)
        r = np.exp(logs - top)
        r /= r.sum(0)
        return np.concatenate([[(top + np.log(np.exp(logs - top).sum(0))).sum()], r.sum(1), (r * h).sum(1), (r * n).sum(1)])

    def maximise(self, sums):
        w, h, n = sums[1:3], sums[3:5], sums[5:7]
        return w / w.sum(), h / n


def test_a_model_of_the_callers_own(spark):
    rng = np.random.default_rng(0)
    coin = rng.random(2000) < 0.4
    rows = [(int(rng.binomial(30, 0.8 if c else 0.3)), 30) for c in coin]
    (w, p), trace = em.fit(spark.createDataFrame(rows, "heads int, throws int"), Coins(), (np.array([0.5, 0.5]), np.array([0.6, 0.5])), rel_tol=1e-9)
    assert (np.diff(trace) >= -1e-6).all()
    assert (w[0], p[0], p[1]) == (pytest.approx(0.4, abs=0.03), pytest.approx(0.8, abs=0.02), pytest.approx(0.3, abs=0.02))
