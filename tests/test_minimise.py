"""Minimal grammars: inside weights don't change, and no two blocks could be one."""

import math

import numpy as np
import pytest

from stemma.operators import grammar, minimise


def test_crafted_grammar(spark):
    """B and C are alike, D has another weight; then A1 and A2, which use them alike, are one too; split weights add up."""
    rules = [("A1", "B", "B", 0.5), ("A2", "C", "B", 0.25), ("A2", "B", "C", 0.25), ("A3", "D", "B", 0.5), ("S", "A1", "A2", 0.3), ("S", "A3", "S", 0.2)]
    emissions = [("B", 0, 0.7), ("B", 1, 0.3), ("C", 1, 0.3), ("C", 0, 0.7), ("D", 0, 0.6), ("D", 1, 0.3), ("S", 1, 0.1)]
    r = spark.createDataFrame(rules, "lhs string, left string, right string, w double")
    e = spark.createDataFrame(emissions, "lhs string, x int, w double")
    made = minimise.blocks(r, e)
    of = {x.lhs: x.block for x in made.collect()}
    assert of["B"] == of["C"] != of["D"] and of["A1"] == of["A2"] != of["A3"] and len(set(of.values())) == 5
    small, emitted = minimise.quotient(r, e, made)
    assert small.count() == 4 and emitted.count() == 5

    def inside(rules, emissions, start, strings):
        number = {n: k for k, n in enumerate(sorted({x for lhs, a, b, _ in rules for x in (lhs, a, b)} | {x[0] for x in emissions}))}
        code = [(number[lhs], number[a], number[b], w) for lhs, a, b, w in rules], [(number[lhs], x, w) for lhs, x, w in emissions]
        found = grammar.parsed(strings, len(number), *code, start=number[start])
        return {row.key: row.inside for row in found.collect()}

    strings = spark.createDataFrame([(k, x) for k, x in enumerate([[1], [0, 1, 1, 0], [1, 0, 1, 1, 0, 0, 1], [0, 0, 1]])], "key long, xs array<int>")
    large = inside(rules, emissions, "S", strings)
    assert large == pytest.approx(inside([tuple(x) for x in small.collect()], [tuple(x) for x in emitted.collect()], of["S"], strings))
    assert math.isfinite(large[1]) and large[1] > grammar.LOG_ZERO


def test_recursion_and_nothing(spark):
    """Two rings of rules that derive alike are one; an empty grammar has no blocks."""
    rules = [("X", "a", "Y", 0.5), ("Y", "a", "X", 0.5), ("U", "a", "U", 0.5)]
    emissions = [("a", 0, 1.0), *((n, 1, 0.5) for n in "XYU")]
    frames = lambda r, e: (spark.createDataFrame(r, "lhs string, left string, right string, w double"), spark.createDataFrame(e, "lhs string, x int, w double"))
    of = {x.lhs: x.block for x in minimise.blocks(*frames(rules, emissions)).collect()}
    assert of["X"] == of["Y"] == of["U"] != of["a"]
    assert minimise.blocks(*frames([], [])).count() == 0
    assert np.isclose(sum(r.w for r in minimise.quotient(*frames(rules, emissions), minimise.blocks(*frames(rules, emissions)))[0].collect()), 0.5)


def test_settled_rules_leave_the_rounds(spark):
    """One long string among many short ones: later rounds are over what is left of the long one."""
    from tests.test_large_tables import rounds

    strings = {k: "ab"[k % 2] * 2 for k in range(300)} | {300: "ab" * 6}
    rules = [(f"{k}:{i}", s[i], f"{k}:{i + 1}", 1.0) for k, s in strings.items() for i in range(len(s) - 1)]
    emissions = [(f"{k}:{len(s) - 1}", ord(s[-1]), 1.0) for k, s in strings.items()] + [(c, ord(c), 1.0) for c in "ab"]
    r, e = spark.createDataFrame(rules, "lhs string, left string, right string, w double"), spark.createDataFrame(emissions, "lhs string, x int, w double")
    found, more = rounds(spark, lambda: minimise.blocks(r, e))
    ends = {s[i:] for s in strings.values() for i in range(len(s))}
    assert len(found) == 2 + sum(map(len, strings.values())) and len({b for _, b in found}) == len(ends)
    assert more < 4 * len(found)
