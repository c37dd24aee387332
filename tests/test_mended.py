"""Cases that once gave wrong or no rows, or failed."""

import importlib
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import expressions as X
from stemma.operators import counts, gaps, mixture, simulate, substitution
from stemma.sources import sequences

TRANS = np.array([[0, 0.5, 0.2, 0.2, 0.1], [0, 0.6, 0.2, 0.1, 0.1], [0, 0.3, 0.4, 0.2, 0.1], [0, 0.3, 0.2, 0.4, 0.1], [0, 0, 0, 0, 0.0]])


def test_exchangeabilities_of_a_pair_counted_one_way(spark):
    n = spark.createDataFrame([(1, 1, 50), (2, 2, 50), (2, 1, 10)], "a int, b int, n long")
    row = substitution.exchangeabilities(n).collect()
    assert [(r.a, r.b) for r in row] == [(1, 2)] and row[0].exchange == pytest.approx(10 / (0.5 * 0.5 * 220))
    turned = substitution.exchangeabilities(n.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).collect()
    assert turned[0].exchange == row[0].exchange


def groups(spark):
    return spark.createDataFrame([(t, 40.0, 12.0, 9.0, 60.0, 4.0, 8.0, 52.0, 6.0) for t in (0.2, 0.9, 2.5)], "tau double, " + ", ".join(f"{g} double" for g in mixture.GROUPS))


def test_link_statistics_at_equal_rates(spark):
    """They are the limit of those on both sides, and the EM starts from there."""
    at = lambda lam, mu: mixture.link_statistics(groups(spark).withColumns({"lam": F.lit(lam), "mu": F.lit(mu)})).agg(*(F.sum(c).alias(c) for c in mixture.STATISTICS)).first()
    equal, below, above = at(0.05, 0.05), at(0.05, 0.05 * 0.99), at(0.05, 0.05 * 1.01)
    for c in mixture.STATISTICS:
        assert equal[c] == pytest.approx((below[c] + above[c]) / 2, rel=1e-3), c
    assert equal["B"] - equal["D"] == pytest.approx(3 * (9 + 4 - 12), rel=1e-6)
    last = mixture.birth_death_em(groups(spark), start=(0.05, 0.05), iterations=3).collect()[-1]
    assert 0 < last.lam < last.mu


def test_gap_tables_give_the_border_the_rest(spark):
    """Over all lengths a gap's chances sum to those of leaving through it, and inner cells are exact lengths."""
    for src, dst in gaps.KINDS.values():
        whole, cut = gaps.probabilities(TRANS, src, dst, 80), gaps.clipped(TRANS, src, dst, 3)
        folded = np.zeros((4, 4))
        for i in range(81):
            for j in range(81):
                folded[min(i, 3), min(j, 3)] += whole[i, j]
        np.testing.assert_allclose(cut, folded, rtol=1e-9)


def test_alignments_have_no_longest(spark):
    """A model that hardly ever ends gives long alignments whole; one that can't end is an error."""
    trans = np.array([[0, 1, 0, 0, 0], [0, 0.999, 0, 0, 0.001], [0, 1, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0.0]])
    emit, single = np.full((4, 4), 1 / 16), np.full(4, 0.25)
    pairs = spark.range(24).withColumnRenamed("id", "pair_id")
    n = {r.pair_id: r.n for r in simulate.alignments(pairs, trans, emit, single, seed=1).groupBy("pair_id").agg(F.count("*").alias("n")).collect()}
    assert len(n) == 24 and 400 < np.mean(list(n.values())) < 2000
    trans[1] = [0, 1, 0, 0, 0]
    with pytest.raises(ValueError, match="reach the end"):
        simulate.alignments(pairs, trans, emit, single)


def test_redrawn_steps_follow_the_shares(spark):
    rows = spark.range(4000).select(F.col("id").alias("pair_id"), (F.col("id") % 2).cast("int").alias("src"), F.when(F.col("id") % 2 == 0, (F.col("id") % 8 / 2).cast("int")).otherwise(4).alias("dst"))
    shares = simulate.transition_shares(rows, 5)
    assert {r.src: list(r.shares) for r in shares.collect()} == {0: [0.25] * 4 + [0.0], 1: [0.0] * 4 + [1.0]}
    got = {(r.src, r.drawn): r.n for r in simulate.redrawn(rows, shares, ["pair_id"]).groupBy("src", "drawn").agg(F.count("*").alias("n")).collect()}
    assert got[1, 4] == 2000 and all(400 < got[0, k] < 600 for k in range(4)) and (0, 4) not in got


def test_newick_of_a_deep_tree(spark):
    """A tree 3,000 levels deep is spelled and parsed again."""
    nodes = [(k, k - 1 if k else None, f"n{k}", 0.5) for k in range(3000)]
    text = sequences.newick(nodes)
    assert text.startswith("(" * 2999) and text.endswith("n1:0.5)n0;")
    assert [(r[0], r[1], r[2]) for r in sequences.newick_edges(text)] == [(k, k - 1 if k else None, f"n{k}") for k in range(3000)]
    assert sequences.newick([(0, None, "r", 0.0), (1, 0, "a", 1.0), (2, 0, "b", 2.0), (3, 2, "c", 0.25)]) == "(a:1,(c:0.25)b:2)r;"


def test_entry_without_the_text_subpackage(tmp_path):
    """Where only bytecode is left of it, or nothing, the other queries are there."""
    root = os.path.dirname(os.path.dirname(importlib.import_module("stemma").__file__))
    for name in ("stemma", "bare"):
        (tmp_path / name).mkdir()
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    for part in os.listdir(f"{root}/stemma"):
        if part != "llm":
            os.symlink(f"{root}/stemma/{part}", tmp_path / "stemma" / part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q)"
    for left in (False, True):
        if left:
            (tmp_path / "stemma" / "llm" / "__pycache__").mkdir(parents=True)
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        n, text, pipeline = said.stdout.split()
        assert int(n) > 100 and text == "0" and pipeline == "False"


def test_equal_rates_of_the_link_model(spark):
    s = 0.7
    row = spark.range(1).select(X.birth_death(F.lit(0.35), F.lit(0.35), F.lit(2.0))["beta"].alias("beta")).first()
    assert row.beta == pytest.approx(s / (1 + s))


def test_placed_transitions(spark):
    columns = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 0, 2)], "pair_id long, pos long, st int")
    assert sorted(map(tuple, counts.placed_transitions(columns).collect())) == [(1, 0, 0, 1), (1, 1, 1, 3), (1, 2, 3, 4), (2, 0, 0, 2), (2, 1, 2, 4)]
