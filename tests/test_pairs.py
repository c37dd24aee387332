"""Fitted pair times and band coordinates against whole tables, differences and drawn pairs."""

import resource

import numpy as np
import pytest

from stemma.operators import banded, beam, pair_times, pairwise, phylogeny, simulate, substitution

RATES = (0.05, 0.07, 0.3)


def model(size=4):
    rng = np.random.default_rng(3)
    pi = rng.dirichlet(np.full(size, 5.0))
    exchange = rng.uniform(0.5, 2, (size, size))
    return pair_times.Model(*RATES, substitution.rate_matrix((exchange + exchange.T) / 2, pi), pi)


def stack(seed=1, n=4, size=4):
    rng = np.random.default_rng(seed)
    nx, ny = rng.integers(0, 9, n), rng.integers(0, 9, n)
    nx[0] = ny[1] = 0
    x, y = (np.array([np.pad(rng.integers(0, size, k), (0, int(v.max()) - k)) for k in v]).reshape(n, -1) for v in (nx, ny))
    return x, y, nx, ny


def test_tables_of_own_times_are_those_of_each_pair():
    m, (x, y, nx, ny) = model(), stack()
    t = np.array([0.1, 0.5, 1.0, 2.5])
    total, steps, matches, p = pair_times.expectations(m.tables(t, x, y, nx, ny), 4)
    for k in range(4):
        one = pair_times.expectations(m.tables(t[k : k + 1], x[k : k + 1], y[k : k + 1], nx[k : k + 1], ny[k : k + 1]), 4)
        for got, want in zip((total[k], steps[..., k], matches[k], p[..., k]), (one[0][0], one[1][..., 0], one[2][0], one[3][..., 0]), strict=True):
            np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_allclose(matches.sum((1, 2)), steps[:, 1].sum(0), atol=1e-9)


def test_the_expected_slope_is_that_of_the_log_probability():
    m, s = model(), stack()
    t, h = np.array([0.3, 0.6, 1.0, 2.0]), 1e-5
    _, steps, matches, _ = pair_times.expectations(m.tables(t, *s), 4)
    slope = (m.expected_loglik(t * (1 + h), steps, matches) - m.expected_loglik(t * (1 - h), steps, matches)) / (2 * h)
    real = (m.tables(t * (1 + h), *s).forward()[1] - m.tables(t * (1 - h), *s).forward()[1]) / (2 * h)
    np.testing.assert_allclose(slope, real, atol=1e-5)
    best = pair_times.newton(m, t, steps, matches, 30)
    around = [m.expected_loglik(np.clip(best * f, pair_times.LEAST, pair_times.GREATEST), steps, matches) for f in (0.99, 1.0, 1.01)]
    assert (around[1] >= around[0] - 1e-6).all() and (around[1] >= around[2] - 1e-6).all()


@pytest.mark.parametrize("true", [0.3, 0.6])
def test_times_of_drawn_pairs_are_found(spark, true):
    """Rounds never lower the log-probability, and the middle fitted time of drawn pairs is near the one they were drawn at."""
    m = model()
    emit = m.joint(np.array([true]))[0]
    long = pair_times.Model(0.099, 0.1, 0.6, (m.left * m.values) @ m.right, m.pi)
    trans = long.transitions(np.array([true]))[..., 0]
    ids = spark.range(30).withColumnRenamed("id", "pair_id")
    pairs = pairwise.ungapped(simulate.alignments(ids, trans, emit, m.pi, seed=3)).where("size(x) between 30 and 120 and size(y) <= 150").cache()
    runs = [{r.pair_id: r for r in pair_times.pair_times(pairs, long, first=0.6, rounds=k).collect()} for k in (1, 6)]
    assert all(runs[1][k].loglik >= runs[0][k].loglik - 1e-6 for k in runs[0])
    assert np.median([r.t for r in runs[1].values()]) == pytest.approx(true, rel=0.3)
    cells = pair_times.match_posteriors(pairs, long, threshold=0.2).collect()
    assert cells and all(0.2 <= c.p <= 1 + 1e-9 and c.t > 0 for c in cells)


def test_distances_feed_neighbour_joining(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 4, 60)
    seqs = {k: [int(v) for v in np.where(rng.random(60) < rate, rng.integers(0, 4, 60), base)] for k, rate in enumerate((0.05, 0.1, 0.3, 0.6))}
    members = spark.createDataFrame([(1, k, s) for k, s in seqs.items()] + [(2, 9, [0, 1])], "fam long, name long, seq array<int>")
    found = pair_times.distances(members, model(), rounds=2)
    d = {(r.x, r.y): r.d for r in found.collect()}
    assert set(d) == {(a, b) for a in range(4) for b in range(4) if a < b} and d[0, 1] < d[0, 2] < d[0, 3]
    tree = phylogeny.neighbour_joining(found).collect()
    assert {r.node for r in tree} >= {0, 1, 2, 3}


def band_mask(trans, emit, single, x, y, centre, width):
    """Plain sums over the cells of a band."""
    f = np.zeros((len(x) + 1, len(y) + 1, 4))
    f[0, 0, 0] = 1
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if abs(j - centre[i]) > width:
                continue
            if i and j:
                f[i, j, 1] = f[i - 1, j - 1] @ trans[:4, 1] * emit[x[i - 1], y[j - 1]]
            if j:
                f[i, j, 2] = f[i, j - 1] @ trans[:4, 2] * single[y[j - 1]]
            if i:
                f[i, j, 3] = f[i - 1, j] @ trans[:4, 3] * single[x[i - 1]]
    return f[-1, -1] @ trans[:4, 4]


def test_bands_against_plain_sums(spark):
    trans, emit, single = pairwise.model_arrays(*RATES[:2], 0.8, RATES[2], 4)
    rng = np.random.default_rng(7)
    pairs = [(rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()) for _ in range(40)]
    rows = [(k, x, y, np.minimum(np.maximum.accumulate(rng.integers(0, len(y) + 1, len(x))), len(y)).tolist() if x else []) for k, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "pair_id long, x array<int>, y array<int>, centres array<long>").coalesce(1)
    whole = {r.pair_id: r.loglik for r in pairwise.pair_likelihoods(df, trans, emit, single).collect()}
    for width in (0, 1, 3, 30):
        got = {r.pair_id: r.loglik for r in pairwise.pair_likelihoods(df, trans, emit, single, band=width).collect()}
        for k, x, y, centres in rows:
            want = band_mask(trans, emit, single, x, y, [*centres, len(y)], width)
            assert got[k] == pytest.approx(np.log(want), abs=1e-9) if want else got[k] <= pairwise.LOG_ZERO / 2
            if width == 30:
                assert got[k] == pytest.approx(whole[k], abs=1e-9)


def test_a_band_of_long_sequences_takes_little_memory():
    """5,000 x 5,000 residues at width 32: whole tables would take 600 MB a state."""
    trans, emit, single = pairwise.model_arrays(0.02, 0.03, 0.5, 0.5, 20)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (1, 5000))
    y = np.where(rng.random((1, 5000)) < 0.2, rng.integers(0, 20, (1, 5000)), x)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = np.array([5000])
    got = banded.log_totals(trans, emit, single, x, y, n, n, np.arange(5001)[None], 32)
    assert -40_000 < got[0] < 0 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_beams(spark):
    """An endless beam is the whole total, narrower ones never exceed it or a wider one, and a long pair keeps few cells."""
    trans, emit, single = pairwise.model_arrays(*RATES[:2], 0.8, RATES[2], 4)
    rng = np.random.default_rng(11)
    pairs = [(k, rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()) for k in range(40)]
    df = spark.createDataFrame(pairs, "pair_id long, x array<int>, y array<int>").coalesce(1)
    whole = {r.pair_id: r.loglik for r in pairwise.pair_likelihoods(df, trans, emit, single).collect()}
    before = None
    for width in (0.5, 3.0, 8.0, np.inf):
        got = {r.pair_id: r.loglik for r in beam.pair_likelihoods(df, trans, emit, single, width).collect()}
        assert all(got[k] <= whole[k] + 1e-9 and (before is None or got[k] >= before[k] - 1e-9) for k in whole)
        before = got
    assert got == pytest.approx(whole)
    x = rng.integers(0, 4, 3000)
    y = np.where(rng.random(3000) < 0.1, rng.integers(0, 4, 3000), x)
    narrow, wide = (beam.log_total(trans, emit, single, x, y, w) for w in (15.0, 25.0))
    assert narrow[1] < 3000 * 60 and narrow[0] <= wide[0] <= narrow[0] + 0.01
