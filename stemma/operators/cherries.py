"""Cherries of trees (node, parent, length): pairs of sibling leaves, picked and pruned again and again."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def strict_cherries(edges: DataFrame) -> DataFrame:
    """parent, a, b, tau, of_leaves: both children of every parent that has two and no more, both leaves.

    Such a parent is a leaf from then on, so the pairs don't depend on the order in which they are picked
    and each round takes all of them; rounds end when one finds none.  Then a root whose children are all
    leaves gives its pairs from the shortest branches up.  ``of_leaves`` tells pairs of the tree's own leaves.
    Equal lengths are taken by name.
    """
    degree = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    own = edges.select("node").join(degree.select("node"), "node", "left_anti")
    open_ = stored(edges.join(degree.withColumnRenamed("node", "parent"), "parent"), "cherries")
    leaves, found = stored(own.withColumn("own", F.lit(True)), "cherries"), None
    while True:
        ends = open_.join(leaves, "node")
        both = ends.where("children = 2").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "length", "own"))).alias("c"))
        ready = stored(both.where("size(c) = 2"), "cherries")
        if ready.isEmpty():
            break
        pairs = _pairs(ready, F.col("c")[0], F.col("c")[1])
        found = pairs if found is None else found.unionAll(pairs)
        leaves = stored(leaves.unionAll(ready.select(F.col("parent").alias("node"), F.lit(False).alias("own"))), "cherries")
        open_ = open_.join(ready.select("parent"), "parent", "left_anti")
    roots = open_.select("parent").distinct().join(edges.select(F.col("node").alias("parent")), "parent", "left_anti")
    ends = open_.join(leaves, "node").join(roots, "parent")
    w = Window.partitionBy("parent")
    ranked = ends.withColumn("_all", F.count("*").over(w)).where("_all = children").withColumn("_k", F.row_number().over(w.orderBy("length", "node")) - 1)
    twos = ranked.groupBy("parent", F.floor(F.col("_k") / 2).alias("_two")).agg(F.sort_array(F.collect_list(F.struct("node", "length", "own"))).alias("c")).where("size(c) = 2")
    last = _pairs(twos, F.col("c")[0], F.col("c")[1])
    return last if found is None else found.unionAll(last)


def _pairs(rows: DataFrame, x, y) -> DataFrame:
    return rows.select("parent", x["node"].alias("a"), y["node"].alias("b"), (x["length"] + y["length"]).alias("tau"), (x["own"] & y["own"]).alias("of_leaves"))


def sibling_cherries(edges: DataFrame) -> DataFrame:
    """tree, a, b, tau: of any two sibling leaves of a tree the nearest first, both removed, until none is left.

    A parent left with one child gives way to it, its branch added; one left with none goes, and the node above
    it counts as a leaf if that was its last child.  Trees (tree, node, parent, length) are a family's, so one
    fits a task; equal tau are taken by names.
    """

    def picked(node: list, parent: list, length: list) -> list[tuple]:
        up, branch, children = dict(zip(node, parent, strict=True)), dict(zip(node, length, strict=True)), {}
        for n, p in up.items():
            children.setdefault(p, set()).add(n)
        heap: list[tuple] = []

        def offer(p):
            ends = sorted((branch[c], c) for c in children.get(p, ()) if c not in children)[:2]
            if len(ends) == 2:
                heapq.heappush(heap, (ends[0][0] + ends[1][0], *sorted((ends[0][1], ends[1][1])), p))

        for p in list(children):
            offer(p)
        out = []
        while heap:
            tau, a, b, p = heapq.heappop(heap)
            if not {a, b} <= children.get(p, set()) or branch[a] + branch[b] != tau:
                continue
            out.append((a, b, tau))
            children[p] -= {a, b}
            left, above = children[p], up.get(p)
            if above is not None and len(left) < 2:
                children.pop(p)
                children[above].discard(p)
                for only in left:
                    branch[only] += branch[p]
                    up[only] = above
                    children[above].add(only)
                if not children[above]:  # it counts as a leaf from now on
                    children.pop(above)
                    above = up.get(above)
                if above is not None:
                    offer(above)
            else:
                offer(p)
        return out

    def run(group: pa.Table) -> pa.Table:
        rows = picked(*(group[c].to_pylist() for c in ("node", "parent", "length")))
        return pa.table([pa.array([group["tree"][0].as_py()] * len(rows), group.schema.field("tree").type), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.float64())))], ["tree", "a", "b", "tau"])

    kind = edges.schema["tree"].dataType.simpleString()
    return edges.select("tree", "node", "parent", F.col("length").cast("double").alias("length")).groupBy("tree").applyInArrow(run, f"tree {kind}, a string, b string, tau double")
