"""Alignments from posteriors: the pairwise decoding with the greatest expected accuracy, and merged multiple alignments."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families, pairwise


def best_chain(i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Indices of the heaviest chain of cells that rises strictly in both i and j, a cell before a gap where both are as heavy.

    A table over the rows and columns that have cells, filled row by row.
    """
    if not len(i):
        return np.zeros(0, int)
    (rows, r), (cols, c) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    cell, weight = np.full((len(rows), len(cols)), -1), np.full((len(rows), len(cols)), -np.inf)
    order = np.argsort(p, kind="stable")  # of repeated cells the heaviest
    cell[r[order], c[order]], weight[r[order], c[order]] = order, p[order]
    best = np.zeros((len(rows) + 1, len(cols) + 1))
    for k in range(len(rows)):
        best[k + 1, 1:] = np.maximum.accumulate(np.maximum(best[k, :-1] + weight[k], best[k, 1:]))
    out, a, b = [], len(rows), len(cols)
    while a and b:
        if best[a, b] == best[a - 1, b - 1] + weight[a - 1, b - 1]:
            a, b = a - 1, b - 1
            out.append(cell[a, b])
        elif best[a, b] == best[a - 1, b]:
            a -= 1
        else:
            b -= 1
    return np.array(out[::-1], int)


def optimal_accuracy(posteriors: DataFrame, key: str = "pair_id") -> DataFrame:
    """The cells (key, i, j, p) of each pair that make up the alignment with the greatest summed posterior.

    A pair's cells travel as one row, so a batch holds many pairs.
    """
    gathered = posteriors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "j", "p"))).alias("cells")).select(key, *(F.col(f"cells.{c}").alias(c) for c in "ijp"))

    def run(batches):
        for pdf in batches:
            keep = [best_chain(np.asarray(i), np.asarray(j), np.asarray(p)) for i, j, p in zip(pdf["i"], pdf["j"], pdf["p"], strict=True)]
            yield pd.DataFrame({key: pdf[key]} | {c: [np.asarray(v)[k] for v, k in zip(pdf[c], keep, strict=True)] for c in "ijp"})

    chosen = gathered.mapInPandas(run, f"{key} long, i array<int>, j array<int>, p array<double>")
    return chosen.select(key, F.explode(F.arrays_zip("i", "j", "p")).alias("c")).select(key, "c.i", "c.j", "c.p")


def strongest_first(lengths: list[int], a: np.ndarray, b: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """A column for each residue, numbered through sequences of ``lengths``, by merging those of cells (residues a and b, p) from the strongest down, ties by residues."""
    keep = np.flatnonzero(p >= threshold)
    if not len(keep):
        return np.arange(sum(lengths))
    keep = keep[np.lexsort((b[keep], a[keep], -p[keep]))]
    state = families.Order(lengths)
    column, has = state.column, state.has
    for u, v in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        u, v = column[u], column[v]
        if u != v and not has[u] & has[v]:
            state.merge(u, v)
    # columns in an order that agrees with every sequence, of those that may come next the one that goes by the least residue
    before, after = state.more[-1], state.more[1]
    waiting = [sum(before[r] for r in rs) for rs in state.residues]
    ready, number = [c for c, rs in enumerate(state.residues) if rs and not waiting[c]], {}
    while ready:
        c = heapq.heappop(ready)
        number[c] = len(number)
        for r in state.residues[c]:
            if after[r]:
                d = column[r + 1]
                waiting[d] -= 1
                if not waiting[d]:
                    heapq.heappush(ready, d)
    return np.array([number[c] for c in column])


def merged_columns(posteriors: DataFrame, threshold: float = 0.5, members: DataFrame | None = None) -> DataFrame:
    """fam, name, pos, col: columns built by taking posteriors (fam, x, i, y, j, p) from the strongest down.

    ``members`` (fam, name, seq) says how long the sequences are; else they end with their last residue that has a posterior.

    Two columns merge where no sequence is in both and no cycle of column orders arises.  A family is
    one bounded group, as the merges depend on each other.
    """

    def run(key, pdf: pd.DataFrame, sizes: pd.DataFrame | None = None) -> pd.DataFrame:
        longest: dict = {} if sizes is None else {n: k for n, k in zip(sizes["name"], sizes["n"], strict=True) if k > 0}
        for n, k in [*zip(pdf["x"], pdf["i"], strict=True), *zip(pdf["y"], pdf["j"], strict=True)]:
            longest[n] = max(longest.get(n, 0), k + 1)
        names = sorted(longest)
        lengths = [longest[n] for n in names]
        first = dict(zip(names, np.cumsum([0, *lengths]).tolist(), strict=False))
        a, b = (pdf[n].map(first).to_numpy(np.int64) + pdf[k].to_numpy(np.int64) if len(pdf) else np.zeros(0, np.int64) for n, k in ("xi", "yj"))
        col = strongest_first(lengths, a, b, pdf["p"].to_numpy(float), threshold)
        pos = [k for n in lengths for k in range(n)]
        return pd.DataFrame({"fam": key[0], "name": np.repeat(np.array(names, np.int64), lengths), "pos": pos, "col": col})

    schema = "fam long, name long, pos int, col int"
    if members is None:
        return posteriors.groupBy("fam").applyInPandas(lambda key, pdf: run(key, pdf), schema)
    sizes = members.select("fam", "name", F.size("seq").alias("n")).groupBy("fam")
    return posteriors.groupBy("fam").cogroup(sizes).applyInPandas(lambda key, pdf, sizes: run(key, pdf, sizes), schema)


def aligned_families(members: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """fam, name, pos, col: each family's sequences (fam, name, seq) aligned, residue by residue.

    Every pair of a family's members gets its match posteriors under the pair model, and columns are merged from
    the strongest cells down to ``threshold``.  A member that no other one can be compared with has columns of its own.
    Families of one block are aligned where their pairs are made, many in a batch; larger ones are a task's group each.
    """

    def patterns() -> families.Patterns:
        def solve(pdf: pd.DataFrame) -> list:
            out = [None] * len(pdf)
            for rows, *stack in pairwise.stacks(pdf, 10):
                t = pairwise.Tables(trans, emit, background, *stack)
                f, total = t.forward()
                p = np.exp(f[1:, 1:, 0] + t.backward()[1:, 1:, 0] - total)
                for k, r in enumerate(rows.tolist()):
                    own = p[: t.nx[k], : t.ny[k], k]
                    i, j = np.nonzero(own >= threshold)
                    out[r] = i, j, own[i, j]
            return out

        return families.Patterns(solve, families.alike(background, emit))

    made = families.blocks(members)
    small = families.aligned(made, patterns, lambda lengths, a, b, p: strongest_first(lengths, a, b, p, threshold))
    rest = made.where("not whole")
    return small.unionByName(merged_columns(families.pair_cells(rest, patterns), threshold, families.members(rest)))
