"""Cases that larger tables have: branches of no length, classes of all columns at once, masks of wide trees."""

import math

import pytest
from pyspark.sql import functions as F

from stemma.operators import phylogeny, trees


def short_tree(spark):
    """A root whose leaves are in state 0, and a node on a branch of no length above a leaf in state 1."""
    rows = [("root", f"o{k}", 0.1) for k in range(4)] + [("root", "c", 0.0), ("c", "o9", 2.0)]
    edges = spark.createDataFrame([(n, p, t) for p, n, t in rows], "node string, parent string, length double")
    leaves = spark.createDataFrame([(f"o{k}", 0) for k in range(4)] + [("o9", 1)], "node string, state int")
    return edges, leaves


def test_no_change_over_a_branch_of_no_length(spark):
    """Its chance is 0, not unknown: node and parent share their state, and joint posteriors are numbers."""
    edges, leaves = short_tree(spark)
    state = {r.node: r.state for r in phylogeny.likeliest_states(edges, leaves, 3).collect()}
    assert state["root"] == state["c"] == 0 and state["o9"] == 1
    cells = {(r.a, r.b): r.p for r in phylogeny.branch_marginals(phylogeny.messages(edges, leaves, 3), 3).where("node = 'c'").collect()}
    assert sum(cells.values()) == pytest.approx(1) and all(cells[a, b] == 0 for a, b in cells if a != b)


def test_a_leaf_of_no_length(spark):
    """A known leaf on such a branch settles its parent."""
    edges = spark.createDataFrame([("x", "root", 0.0), ("y", "root", 1.0)], "node string, parent string, length double")
    leaves = spark.createDataFrame([("x", 1), ("y", 0)], "node string, state int")
    row = phylogeny.pruning(edges, leaves, 3).where(F.col("node") == "root").first()
    assert row.l1 == pytest.approx(math.log((1 - math.exp(-1.5)) / 3)) and max(row.l0, row.l2) < -1e29


def rounds(spark, call):
    """(what ``call`` gives, the rows of all intermediate tables that it wrote)."""
    import glob

    from stemma.functions import storage

    written, own = [], storage.scratch
    storage.scratch = lambda *a: written.append(own(*a)) or written[-1]
    try:
        out = sorted(map(tuple, call().collect()))
    finally:
        storage.scratch = own
    return out, sum(spark.read.parquet(w).count() for w in written if glob.glob(f"{w}/*.parquet"))


def test_rounds_over_a_tree_leave_leaves_out(spark):
    """Leaves are written once at most, however many levels are above them."""
    n = 400
    rows = [("r", None, 0)] + [(f"a{k}", "r", 1) for k in range(2)] + [(f"b{k}", f"a{k % 2}", 2) for k in range(4)] + [(f"o{k}", f"b{k % 4}", 3) for k in range(n)]
    edges = spark.createDataFrame([(x, p, 0.5) for x, p, _ in rows if p], "node string, parent string, length double")
    masks = spark.createDataFrame([(f"o{k}", 1 << (k % 4 // 2)) for k in range(n)], "node string, mask int")
    sets, more = rounds(spark, lambda: trees.parsimony(edges, masks, 3))
    assert dict(sets)["b0"] == 1 and dict(sets)["b3"] == 2 and dict(sets)["a0"] == 3 == dict(sets)["r"] and len(sets) == len(rows)
    assert more < n / 4
    made, more = rounds(spark, lambda: trees.resolved(edges, spark.createDataFrame(sets, "node string, mask int"), 3))
    assert len(made) == len(rows) and more < 2 * n
    leaves = masks.select("node", (F.col("mask") - 1).alias("state"))
    _, more = rounds(spark, lambda: phylogeny.pruning(edges, leaves, 3))
    assert more < n / 4


def test_rates_of_all_classes_at_once(spark):
    """Columns of weights at several speeds are those of trees with longer branches, and site rates go through the tree once."""
    edges, leaves = short_tree(spark)
    both = phylogeny.pruning(edges, leaves, 3, speeds=[0.5, 2.0]).where("node = 'root'").first()
    for k, r in enumerate([0.5, 2.0]):
        one = phylogeny.pruning(edges.withColumn("length", F.col("length") * r), leaves, 3).where("node = 'root'").first()
        assert [both[f"l{s}_{k}"] for s in range(3)] == pytest.approx([one[f"l{s}"] for s in range(3)])


def test_weights_above_leaves_are_written_once(spark):
    """Sums over leaves are what their parents have: they are neither summed nor written again."""
    from stemma.functions import storage

    rows = [(f"c{k}", "root", 0.5) for k in range(50)] + [(f"o{k}", f"c{k % 50}", 0.3) for k in range(100)]
    edges = spark.createDataFrame(rows, "node string, parent string, length double")
    leaves = spark.createDataFrame([(f"o{k}", c, (k + c) % 3) for k in range(100) for c in range(4)], "node string, col int, state int")
    written, own = [], storage.scratch
    storage.scratch = lambda *a: written.append(own(*a)) or written[-1]
    try:
        made = phylogeny.pruning(edges, leaves, 3, by=["col"])
        assert made.where("substr(node, 1, 1) = 'c'").count() == 200 and made.where("node = 'root'").count() == 4
    finally:
        storage.scratch = own
    weights = [t.count() for t in map(spark.read.parquet, written) if "l0" in t.columns]
    assert sorted(weights) == [4, 200]
