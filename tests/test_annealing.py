"""Annealed alignments: consistent columns, weights that follow merges, refinement that never loses, and large families."""

import resource
import time

import numpy as np
import pytest

from stemma.operators import annealing, decoding, families, pair_times, substitution


def family(seed, n=5, length=8, density=0.5):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, length + 1, n).tolist()
    cells = []
    for x in range(n):
        for y in range(x + 1, n):
            p = rng.random((lengths[x], lengths[y])) * (rng.random((lengths[x], lengths[y])) < density)
            if p.size:
                p /= max(1.0, p.sum(0).max(), p.sum(1).max())
            cells += [(x, int(i), y, int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)]
    return annealing.Family(lengths, cells), cells


def consistent(f, column):
    for x in range(len(f.lengths)):
        assert (np.diff(column[f.first[x] : f.first[x + 1]]) > 0).all()


@pytest.mark.parametrize("seed", range(25))
def test_columns_agree_with_every_sequence(seed):
    f, _ = family(seed)
    first = annealing.built(f, 0.2)
    consistent(f, first)
    last = annealing.annealed(f, gap_factor=0.2)
    consistent(f, last)
    assert f.accuracy(last, 0.2) >= f.accuracy(first, 0.2) - 1e-9
    for x in range(len(f.lengths)):
        if f.lengths[x]:
            new, more = annealing.reinserted(f, first, x, 0.2)
            consistent(f, new)
            assert more == pytest.approx(f.accuracy(new, 0.2) - f.accuracy(first, 0.2)) and more >= -1e-12


@pytest.mark.parametrize("seed", range(12))
def test_reinsertion_is_the_best_of_all(seed):
    """Of two sequences, taking one out and aligning it anew gives the greatest gain of all alignments."""
    f, _ = family(seed, n=2, length=5, density=0.8)
    n, m = f.lengths
    if not n or not m:
        return

    def best(i, j):
        if i == n or j == m:
            return 0.0
        return max(best(i + 1, j), best(i, j + 1), f.gain(i, n + j, 0.3) + best(i + 1, j + 1))

    column, _ = annealing.reinserted(f, np.arange(n + m), 0, 0.3)
    consistent(f, column)
    assert f.accuracy(column, 0.3) == pytest.approx(best(0, 0))


@pytest.mark.parametrize("seed", range(8))
def test_weights_are_those_of_the_members(seed):
    """A column's sums are those over its residues after any merges."""
    f, _ = family(seed, n=4, length=5)
    state, rng = annealing.Columns(f), np.random.default_rng(seed)
    for _ in range(12):
        live = [c for c in range(len(state.residues)) if state.residues[c]]
        if len(live) < 2:
            break
        a, b = sorted(rng.choice(live, 2, replace=False).tolist())
        worth = state.worth(a, b)
        if worth is None:
            continue
        pairs = [(r, s) for r in state.residues[a] for s in state.residues[b]]
        gaps = sum(f.gap[r, f.member[s]] + f.gap[s, f.member[r]] for r, s in pairs)
        assert worth == pytest.approx(2 * sum(f.p[r].get(s, 0.0) for r, s in pairs) / gaps if gaps else 0.0)
        state.merge(a, b)
        live = sorted((c for c in range(len(state.residues)) if state.residues[c]), key=state.place.__getitem__)
        rank = {c: k for k, c in enumerate(live)}
        assert len({state.place[c] for c in live}) == len(live)
        for x in range(len(f.lengths)):
            assert (np.diff([rank[state.column[r]] for r in range(f.first[x], f.first[x + 1])]) > 0).all()


@pytest.mark.parametrize("seed", range(8))
def test_never_less_accurate_than_static_weights(spark, seed):
    if seed:
        f, cells = family(seed, n=4, length=6)
    else:
        f, cells = family(0, n=6, length=7)
    rows = [(1, x, i, y, j, p) for x, i, y, j, p in cells]
    members = spark.createDataFrame([(1, x, [0] * n) for x, n in enumerate(f.lengths)], "fam long, name long, seq array<int>")
    posteriors = spark.createDataFrame(rows, "fam long, x long, i int, y long, j int, p double")
    if seed < 2:  # through Spark
        col = lambda df: np.array([r.col for r in df.orderBy("name", "pos").collect()])
        old, new = col(decoding.merged_columns(posteriors, 0.1, members)), col(annealing.annealed_families(members, posteriors, gap_factor=0.2))
        assert len(old) == len(new) == sum(f.lengths)
        consistent(f, new)
        assert f.accuracy(new, 0.2) >= f.accuracy(old, 0.2) - 1e-9


def test_a_family_of_two_hundred(spark):
    """200 sequences of 300 residues in one group, cells near the diagonal."""
    rng = np.random.default_rng(1)
    n, length = 200, 300
    cells = []
    for x in range(n):
        for y in rng.choice(n, 6, replace=False).tolist():
            if x < y:
                p = rng.uniform(0.6, 0.95, length)
                cells += [(x, i, y, i, float(v)) for i, v in enumerate(p)]
                cells += [(x, i, y, i + 1, float(0.9 - v) / 2) for i, v in enumerate(p[:-1]) if v < 0.85]
    before, begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    column = annealing.annealed(annealing.Family([length] * n, cells), sweeps=1)
    assert time.time() - begun < 300 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    assert (np.diff(column.reshape(n, length), axis=1) > 0).all() and column.max() < 2 * length


@pytest.mark.parametrize("seed", range(15))
def test_members_left_in_place_gain_nothing(seed):
    """Only members that another place may help are taken out: the rest would stay, and the alignment is that of trying all."""
    f, _ = family(seed, n=6, length=7)
    column = annealing.built(f, 0.3)
    gains = f.gains(0.3)
    for a in range(len(f.member)):
        for b in range(len(f.member)):
            assert gains[a, b] == pytest.approx(f.gain(a, b, 0.3) if f.member[a] != f.member[b] else 0)
    open_ = annealing.doubtful(f, gains, column)
    for x in range(6):
        if f.lengths[x] and not open_[x]:
            assert annealing.reinserted(f, column, x, 0.3)[1] <= 1e-10
    for _ in range(5):
        improved = False
        rng = np.random.default_rng(42) if _ == 0 else rng
        for x in rng.permutation(6).tolist():
            if f.lengths[x]:
                new, more = annealing.reinserted(f, column, x, 0.3)
                if more > 1e-10:
                    column, improved = new, True
        if not improved:
            break
    assert annealing.annealed(f, gap_factor=0.3).tolist() == column.tolist()


def test_families_in_batches_are_those_of_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k % 7, k, rng.integers(0, 4, rng.integers(0, 6)).tolist()) for k in range(40)]
    members = spark.createDataFrame(rows, "fam long, name long, seq array<int>")
    model = pair_times.Model(0.03, 0.05, 0.4, *substitution.equal_rates(4))
    groups, own = [], annealing.annealed_families
    monkeypatch.setattr(annealing, "annealed_families", lambda m, *a, **how: groups.append(m.count()) or own(m, *a, **how))
    made = lambda: sorted(map(tuple, annealing.annealed_members(members, lambda: pair_times.member_cells(model)).collect()))
    whole = made()
    assert len(whole) == sum(len(r[2]) for r in rows) and groups == [0]
    blocks = families.blocks
    monkeypatch.setattr(families, "blocks", lambda m: blocks(m, 2))
    assert made() == whole and groups[1] == 40
