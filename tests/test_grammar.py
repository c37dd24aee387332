"""Grammars and silent states against enumerated parses, fixed points and differences of the log-likelihood."""

import itertools
import math

import numpy as np
import pytest

from stemma.operators import closures, grammar
from stemma.plans import structure_queries as queries

RULES, EMISSIONS = [(0, 0, 0, 0.3), (0, 1, 2, 0.2), (2, 0, 1, 0.6), (2, 1, 1, 0.4), (0, 2, 0, 0.1)], [(0, 0, 0.2), (0, 1, 0.2), (1, 0, 0.5), (1, 1, 0.5), (2, 1, 0.05)]
STRINGS = [[], [0], [1, 0], [0, 1, 1], [1, 1, 0, 0], [0, 1, 0, 1, 1], [1] * 6, [0, 0, 1, 0, 1, 1, 0]]


def parses(x, a, i, j):
    """(weight, rules, emissions, nodes) of every parse of x[i:j] from a; nodes are (nonterminal, begin, end) in preorder."""
    out = []
    if j - i == 1:
        out += [(w, (), (e,), ((a, i, j),)) for e, (lhs, s, w) in enumerate(EMISSIONS) if lhs == a and s == x[i]]
    for r, (lhs, b, c, w) in enumerate(RULES):
        if lhs == a:
            for k in range(i + 1, j):
                for left, right in itertools.product(parses(x, b, i, k), parses(x, c, k, j)):
                    out.append((w * left[0] * right[0], (r, *left[1], *right[1]), left[2] + right[2], ((a, i, j), *left[3], *right[3])))
    return out


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "key long, xs array<int>").coalesce(1)


def test_weights_counts_and_parses_against_all_parses(strings):
    every = [parses(x, 0, 0, len(x)) if x else [] for x in STRINGS]
    for r in grammar.parsed(strings, 3, RULES, EMISSIONS).collect():
        weights = [p[0] for p in every[r.key]]
        assert (r.inside, r.best) == (pytest.approx(math.log(sum(weights))), pytest.approx(math.log(max(weights)))) if weights else r.inside == r.best == grammar.LOG_ZERO
    rules, emissions = np.zeros(len(RULES)), np.zeros(len(EMISSIONS))
    for ways in every:
        total = sum(p[0] for p in ways)
        for w, used, emitted, _ in ways:
            np.add.at(rules, list(used), w / total)
            np.add.at(emissions, list(emitted), w / total)
    got = {(r.kind, r.number): r.n for r in grammar.rule_counts(strings, 3, RULES, EMISSIONS).collect()}
    np.testing.assert_allclose([got["rule", k] for k in range(len(RULES))], rules, rtol=1e-9)
    np.testing.assert_allclose([got["emission", k] for k in range(len(EMISSIONS))], emissions, rtol=1e-9)
    found = {}
    for r in grammar.likeliest_parses(strings, 3, RULES, EMISSIONS).orderBy("key", "node").collect():
        found.setdefault(r.key, []).append(r)
    assert sorted(found) == [k for k, ways in enumerate(every) if ways]
    for k, nodes in found.items():
        best = max(p[0] for p in every[k])
        assert tuple((n.nonterminal, n.begin, n.end) for n in nodes) in [p[3] for p in every[k] if p[0] >= best * (1 - 1e-12)]
        for n in nodes[1:]:
            above = nodes[n.parent]
            assert above.node < n.node and above.begin <= n.begin and n.end <= above.end


def test_a_right_linear_grammar_counts_as_its_chain(spark):
    """Expected counts of A > x A as a grammar are those of the Markov chain's only path."""
    rules, emissions = [(0, 1, 0, 0.5), (0, 2, 0, 0.3)], [(1, 0, 1.0), (2, 1, 1.0), (0, 2, 0.2)]
    x = [0, 1, 1, 0, 2]
    df = spark.createDataFrame([(1, x)], "key long, xs array<int>")
    got = {(r.kind, r.number): r.n for r in grammar.rule_counts(df, 3, rules, emissions).collect()}
    assert got == pytest.approx({("rule", 0): 2, ("rule", 1): 2, ("emission", 0): 2, ("emission", 1): 2, ("emission", 2): 1})


def test_long_strings(spark):
    """256 symbols in one chart; longer ones than asked for are refused."""
    df = spark.createDataFrame([(1, [k % 2 for k in range(256)]), (2, [0] * 9)], "key long, xs array<int>")
    got = {r.key: r for r in grammar.parsed(df, 3, RULES, EMISSIONS).collect()}
    assert -1000 < got[1].best <= got[1].inside < 0
    n = {(r.kind, r.number): r.n for r in grammar.rule_counts(df, 3, RULES, EMISSIONS).collect()}
    assert sum(v for (kind, _), v in n.items() if kind == "emission") == pytest.approx(256 + 9) and sum(v for (kind, _), v in n.items() if kind == "rule") == pytest.approx(255 + 8)
    with pytest.raises(Exception, match="longer than max_length"):
        grammar.parsed(df, 3, RULES, EMISSIONS, max_length=100).collect()


def fixed_point(x, rules, emissions, n):
    """Inside weights of all spans of a grammar with empty and single right-hand sides, by repeating its equations."""
    length = len(x)
    p = np.zeros((n, length + 1, length + 1))
    for _ in range(400):
        new = np.zeros_like(p)
        for i in range(length + 1):
            for j in range(i, length + 1):
                for lhs, rhs, w in rules:
                    if not rhs:
                        new[lhs, i, j] += w * (i == j)
                    elif len(rhs) == 1:
                        new[lhs, i, j] += w * p[rhs[0], i, j]
                    else:
                        new[lhs, i, j] += w * sum(p[rhs[0], i, k] * p[rhs[1], k, j] for k in range(i, j + 1))
                if j == i + 1:
                    for lhs, s, w in emissions:
                        new[lhs, i, j] += w * (s == x[i])
        p = new
    return p


def test_closed_grammar(spark):
    """Weights of nonempty strings don't change, and restored counts are the log-likelihood's derivatives by the rules' weights."""
    rules, emissions = queries.WIDE_RULES, queries.WIDE_EMISSIONS
    closed = closures.Closed(3, rules, emissions)
    xs = [[0], [1], [2, 0], [0, 1, 2]]
    np.testing.assert_allclose(closed.null, fixed_point([], rules, emissions, 3)[:, 0, 0], rtol=1e-9)
    logs = lambda r, e: sum(math.log(fixed_point(x, r, e, 3)[0, 0, len(x)]) for x in xs)
    df = spark.createDataFrame(list(enumerate(xs)), "key long, xs array<int>")
    assert sum(r.inside for r in grammar.parsed(df, 3, closed.rules, closed.emissions).collect()) == pytest.approx(logs(rules, emissions), rel=1e-9)
    found = {(r.kind, r.number): r.n for r in grammar.rule_counts(df, 3, closed.rules, closed.emissions).collect()}
    of_rules, of_emissions = closed.restored(*(np.array([found[kind, k] for k in range(len(rows))]) for kind, rows in (("rule", closed.rules), ("emission", closed.emissions))))
    h = 1e-4
    for k in range(len(rules)):
        up, down = ([(a, b, w * (1 + s * h * (m == k))) for m, (a, b, w) in enumerate(rules)] for s in (1, -1))
        assert of_rules[k] == pytest.approx((logs(up, emissions) - logs(down, emissions)) / (2 * h), abs=1e-5), rules[k]
    for k in range(len(emissions)):
        up, down = ([(a, b, w * (1 + s * h * (m == k))) for m, (a, b, w) in enumerate(emissions)] for s in (1, -1))
        assert of_emissions[k] == pytest.approx((logs(rules, up) - logs(rules, down)) / (2 * h), abs=1e-5)


def test_endless_loops_are_refused():
    with pytest.raises(ValueError, match="loop of silent steps"):
        closures.Closed(2, [(0, (1,), 1.0), (1, (0,), 1.0)], [(0, 0, 1.0)])
    with pytest.raises(ValueError, match="converge"):
        closures.nullable(1, [(0, (0, 0), 3.0), (0, (), 1.0)], rounds=50)


def chain_loglik(t, start, emit, x):
    t = closures.closed_chain(t, [2, 3])
    f = start * emit[:, x[0]]
    for s in x[1:]:
        f = (f @ t) * emit[:, s]
    return math.log(f.sum())


def test_restored_chain():
    """Counts through silent states are derivatives of the log-likelihood, and as much enters each silent state as leaves it."""
    t, start, emit = np.array(queries.SILENT), np.array([0.6, 0.4]), np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])
    x = [0, 2, 1, 1, 0, 2, 2]
    closed = closures.closed_chain(t, [2, 3])
    np.testing.assert_allclose(closed.sum(1), 1)
    h = 1e-5
    scaled = lambda base, i, j, s: base + s * h * base[i, j] * (np.arange(len(base))[:, None] == i) * (np.arange(len(base)) == j)

    def direct(c):
        f = start * emit[:, x[0]]
        for s in x[1:]:
            f = (f @ c) * emit[:, s]
        return math.log(f.sum())

    counts = np.array([[(direct(scaled(closed, i, j, 1)) - direct(scaled(closed, i, j, -1))) / (2 * h) for j in range(2)] for i in range(2)])
    found = closures.restored_chain(t, [2, 3], counts)
    for i, j in itertools.product(range(4), range(4)):
        assert found[i, j] == pytest.approx((chain_loglik(scaled(t, i, j, 1), start, emit, x) - chain_loglik(scaled(t, i, j, -1), start, emit, x)) / (2 * h), abs=1e-6)
    np.testing.assert_allclose(found[:, 2:].sum(0), found[2:].sum(1))


def test_first_order_chain():
    """With weights by visits, the symbols' chain has the model's own frequencies of neighbouring symbols; a chain of symbols is itself."""
    t = np.array([[0, 0.5, 0.3, 0.2, 0], [0, 0.3, 0.2, 0.3, 0.2], [0, 0.25, 0.25, 0.25, 0.25], [0, 0.4, 0.4, 0.1, 0.1], [0, 0, 0, 0, 0]])
    emit = np.array([[0, 0], [0.9, 0.1], [0.2, 0.8], [0, 0], [0, 0]])
    made = closures.first_order(t, emit, closures.visits(t, emit))
    np.testing.assert_allclose(made[:3].sum(1), 1)
    n_symbols = lambda c: c[0, 1:3] @ np.linalg.inv(np.eye(2) - c[1:3, 1:3])
    np.testing.assert_allclose(n_symbols(made), closures.visits(t, emit) @ emit[1:3])
    plain = closures.first_order(made, np.array([[0, 0], [1, 0], [0, 1], [0, 0]]))
    np.testing.assert_allclose(plain[:3], made[:3])
    alike = closures.first_order(t, emit)
    closed = closures.closed_chain(t, [3])
    pairs, ends = emit[1:3].T @ closed[1:3, 1:3] @ emit[1:3], emit[1:3].T @ closed[1:3, 3]
    np.testing.assert_allclose(alike[1:3, 1:3], pairs / (pairs.sum(1) + ends)[:, None])
