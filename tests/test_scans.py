"""Blocked recurrences against plain loops, over sequences that span many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import markov, paths, scans

LENGTHS = {1: 1, 2: 700, 3: 64, 4: 3, 5: 65, None: 130}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(k, i, float(rng.uniform(0, 1)), float(rng.normal()), int(rng.integers(0, 3)), "more") for k, n in LENGTHS.items() for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame([(None if k is None else int(k), int(i), float(e), float(v), int(x), m) for k, i, e, v, x, m in data], "k long, i long, eta double, v double, x int, _more string").repartition(3)


def by_key(found, *columns):
    out = {}
    for r in found.orderBy("k", "i").collect():
        out.setdefault(r.k, []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("block", [1, 7, 64, scans.BLOCK])
def test_moving_average_and_weights(rows, block, monkeypatch):
    monkeypatch.setattr(scans.affine, "__kwdefaults__", scans.affine.__kwdefaults__ | {"block": block})
    averages = by_key(paths.moving_average(rows, "k", ["i"], "v", F.col("eta"), 2.0), "eta", "v", "ema")
    weights = by_key(paths.decayed_weights(rows, "k", ["i"], "eta"), "eta", "weight")
    assert {k: len(v) for k, v in averages.items()} == LENGTHS
    for k in LENGTHS:
        state = 2.0
        for eta, v, ema in averages[k]:
            state = (1 - eta) * state + eta * v
            assert ema == pytest.approx(state, rel=1e-9, abs=1e-12)
        keep = 1.0
        for eta, weight in reversed(weights[k]):
            assert weight == pytest.approx(eta * keep, rel=1e-9, abs=1e-300)
            keep *= 1 - eta


def test_null_values_make_what_follows_null(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (2, 0, 4.0)], "k long, i long, v double")
    assert by_key(paths.moving_average(rows, "k", ["i"], "v", F.lit(0.5), 0.0), "ema") == {1: [(0.5,), (None,), (None,)], 2: [(2.0,)]}
    assert paths.moving_average(rows.where("false"), "k", ["i"], "v", F.lit(0.5), 0.0).count() == 0


@pytest.mark.parametrize("block", [5, 64, scans.BLOCK])
def test_state_posteriors(rows, block):
    rng = np.random.default_rng(2)
    n = 3
    start, trans, emit = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), rng.dirichlet(np.ones(3), n)
    start[1], trans[0, 2] = 0, 0
    found = by_key(scans.state_posteriors(rows, "k", "i", "x", start, trans, emit, block=block), "loglik", "posteriors")
    symbols = by_key(rows, "x")
    for k, length in LENGTHS.items():
        loglik, gamma, _, _ = markov.decode_arrays(np.array([s for s, in symbols[k]]), np.array([length]), start, trans, emit)
        np.testing.assert_allclose([p for _, p in found[k]], gamma, atol=1e-9)
        np.testing.assert_allclose([ll for ll, _ in found[k]], loglik[0], rtol=1e-9)
