"""Multiple alignments of a family by annealing its pairs' match posteriors.

Every residue begins as a column of its own.  Columns merge from the best pair down, where a pair's worth is
2 * (summed posteriors of aligned residues) / (summed chances that either is unaligned), over all of
their members; it changes as columns grow, so a pair is weighed again when its turn comes and waits if
others have become better.  Columns are kept in an order that agrees with all sequences: a merge searches only between
its two places in it, which finds a cycle or gives the new order.  Then each sequence in turn is taken out and
aligned anew to the columns of the others, as long as the expected accuracy grows.

A family is one task's group, since its merges depend on each other; its memory is members times residues numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families

LEAST_GAP = 1e-4  # fixed floor of a residue's chance to be unaligned
TABLE = 512  # residues of a family up to which it has tables of all pairs of them


class Family:
    """Posteriors of a family: cells (x, i, y, j, p) of members numbered from 0, of the given lengths."""

    def __init__(self, lengths: list[int], cells: list[tuple[int, int, int, int, float]], compared: set[tuple[int, int]] | None = None):
        x, i, y, j, p = (np.array(c) for c in zip(*cells, strict=True)) if cells else [np.zeros(0, int)] * 5
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        self._fill(lengths, first[x] + i, first[y] + j, np.asarray(p, float), compared)

    @classmethod
    def of(cls, lengths: list[int], a: np.ndarray, b: np.ndarray, p: np.ndarray) -> Family:
        """A family of cells (residues a and b, p), residues numbered through."""
        made = cls.__new__(cls)
        made._fill(lengths, a, b, p, None)
        return made

    def _fill(self, lengths, a, b, p, compared) -> None:
        self.lengths, n = lengths, len(lengths)
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        self.member = np.repeat(np.arange(n), lengths)
        self.p: list[dict[int, float]] = [{} for _ in range(self.first[-1])]
        for u, v, w in zip(a.tolist(), b.tolist(), p.tolist(), strict=True):
            self.p[u][v] = self.p[v][u] = w
        met = np.zeros((n, n), bool)
        x, y = (self.member[a], self.member[b]) if compared is None else np.array(sorted(compared), int).reshape(-1, 2).T
        met[x, y] = met[y, x] = True
        #: of each residue: the chance to be unaligned with each other member, 0 where the two weren't compared
        self.gap = met[self.member].astype(float)
        np.subtract.at(self.gap, (a, self.member[b]), p)
        np.subtract.at(self.gap, (b, self.member[a]), p)
        self.gap = np.where(self.gap != 0, np.maximum(self.gap, LEAST_GAP), 0)
        self.cells = a, b, p

    def gains(self, gap_factor: float) -> np.ndarray | None:
        """``gain`` of all pairs of residues, none within a member, as a table; None for a family whose table would be large."""
        if len(self.member) > TABLE:
            return None
        a, b, p = self.cells
        out = -gap_factor * self.gap[:, self.member]
        out += out.T
        out[a, b] += 2 * p
        out[b, a] += 2 * p
        out[self.member[:, None] == self.member] = 0
        return out

    def accuracy(self, column: np.ndarray, gap_factor: float) -> float:
        """What an alignment (a column for each residue) gains over no alignment: 2 p less both gaps over all aligned pairs."""
        total = 0.0
        order = np.argsort(column, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
            for k, a in enumerate(part.tolist()):
                for b in part[k + 1 :].tolist():
                    total += self.gain(a, b, gap_factor)
        return total

    def gain(self, a: int, b: int, gap_factor: float) -> float:
        return 2 * self.p[a].get(b, 0.0) - gap_factor * (self.gap[a, self.member[b]] + self.gap[b, self.member[a]])


class Columns(families.Order):
    """Columns under way, with summed weights between them."""

    def __init__(self, family: Family):
        super().__init__(family.lengths)
        self.match = [dict(d) for d in family.p]
        self.gap = family.gap.tolist() if len(family.member) <= TABLE else list(family.gap)

    def worth(self, a: int, b: int) -> float | None:
        """2 * matches / gaps of merging two columns; None where a member is in both."""
        if self.has[a] & self.has[b]:
            return None
        of_a, of_b, member = self.gap[a], self.gap[b], self.member
        gaps = sum([of_a[member[r]] for r in self.residues[b]]) + sum([of_b[member[r]] for r in self.residues[a]])
        return 2 * self.match[a].get(b, 0.0) / float(gaps) if gaps > 0 else 0.0

    def merge(self, a: int, b: int) -> bool:
        """Merges column b into a unless one must come before the other."""
        if not super().merge(a, b):
            return False
        self.gap[a] = [u + v for u, v in zip(self.gap[a], self.gap[b], strict=True)]
        for c, w in self.match[b].items():
            self.match[c].pop(b, None)
            if c != a:
                self.match[a][c] = self.match[c][a] = self.match[a].get(c, 0.0) + w
        self.match[b] = {}
        self.match[a].pop(a, None)
        return True


def built(family: Family, gap_factor: float) -> np.ndarray:
    """A column number for each residue, in the columns' order, by merges from the best pair down."""
    a, b, p = family.cells
    gaps = family.gap[a, family.member[b]] + family.gap[b, family.member[a]]
    w = np.divide(2 * p, gaps, out=np.zeros(len(p)), where=gaps > 0)
    seeds = np.flatnonzero(w >= gap_factor)
    if not len(seeds):
        return np.arange(len(family.member))
    state = Columns(family)
    heap = list(zip((-w[seeds]).tolist(), np.minimum(a, b)[seeds].tolist(), np.maximum(a, b)[seeds].tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        w, a, b = heapq.heappop(heap)
        a, b = sorted((state.column[a], state.column[b]))
        if a == b:
            continue
        now = state.worth(a, b)
        if now is None or now < gap_factor:
            continue
        if heap and -now > heap[0][0] and now < -w - 1e-12:  # others have become better
            heapq.heappush(heap, (-now, a, b))
            continue
        state.merge(a, b)
    return np.unique(np.array([state.place[c] for c in state.column]), return_inverse=True)[1] if state.column else np.zeros(0, int)


def reinserted(family: Family, column: np.ndarray, x: int, gap_factor: float) -> tuple[np.ndarray, float]:
    """(the alignment with member ``x`` taken out and aligned anew to the columns of the others, how much more accurate it is)."""
    lo, hi = family.first[x], family.first[x + 1]
    rest = np.delete(np.arange(len(column)), np.arange(lo, hi))
    names, where = np.unique(column[rest], return_inverse=True)
    n, m = hi - lo, len(names)
    has = np.zeros((m, len(family.lengths)))
    has[where, family.member[rest]] = 1
    gain = -gap_factor * (family.gap[lo:hi] @ has.T + np.bincount(where, family.gap[rest, x], m))
    at = dict(zip(rest.tolist(), where.tolist(), strict=True))
    for i in range(n):
        for b, p in family.p[lo + i].items():
            gain[i, at[b]] += 2 * p
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, :-1] + gain[i], best[i, 1:]))
    chosen, i, j = {}, n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen[i] = j
    # columns of the others are even numbers, residues on their own go after the last one taken
    out, last, alone = np.zeros((len(column), 2), int), -2, 0
    out[rest, 0] = 2 * where
    for k in range(n):
        if k in chosen:
            last, alone = 2 * chosen[k], 0
            out[lo + k] = last, 0
        else:
            alone += 1
            out[lo + k] = last + 1, alone
    old = np.searchsorted(names, column[lo:hi])
    with_others = (old < m) & (names[np.minimum(old, m - 1)] == column[lo:hi]) if m else np.zeros(n, bool)
    before = gain[np.flatnonzero(with_others), old[with_others]].sum()
    return np.unique(out, axis=0, return_inverse=True)[1].ravel(), float(best[n, m] - before)


def doubtful(family: Family, gains: np.ndarray | None, column: np.ndarray) -> np.ndarray:
    """Which members another place might help: those whose residues would gain if each could choose its column for itself."""
    if gains is None:
        return np.array(family.lengths) > 0
    put = np.zeros((len(column), int(column.max(initial=-1)) + 1))
    put[np.arange(len(column)), column] = 1
    of = gains @ put
    more = np.maximum(of.max(1, initial=0), 0) - of[np.arange(len(column)), column]
    return np.bincount(family.member, more, len(family.lengths)) > 1e-11


def annealed(family: Family, *, gap_factor: float = 1.0, sweeps: int = 5, seed: int = 42) -> np.ndarray:
    """A column for each residue of a family: built by merges, then refined until no member's new place gains.

    A member is taken out only where that may help, and not again while the alignment is the one it was tried in.
    """
    column = built(family, gap_factor)
    gains = family.gains(gap_factor)
    open_ = doubtful(family, gains, column)
    if not open_.any():
        return column
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        improved = False
        for x in rng.permutation(len(family.lengths)).tolist():
            if open_[x]:
                new, more = reinserted(family, column, x, gap_factor)
                open_[x] = False
                if more > 1e-10:
                    column, improved = new, True
                    open_ = doubtful(family, gains, column)
        if not improved:
            break
    return column


def annealed_families(members: DataFrame, posteriors: DataFrame, *, gap_factor: float = 1.0, sweeps: int = 5, seed: int = 42) -> DataFrame:
    """fam, name, pos, col: each family's sequences (fam, name, seq) aligned by its match posteriors (fam, x, i, y, j, p).

    Members without a residue have no rows, those without posteriors columns of their own; what isn't in ``posteriors`` counts as
    a chance to be unaligned.  A name that comes twice in a family is an error.
    """
    lengths = members.select("fam", "name", F.coalesce(F.size("seq"), F.lit(0)).alias("n"))

    def run(left, right):
        names = left["name"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        number = {names[k]: r for r, k in enumerate(order)}
        if len(number) != len(names):
            raise ValueError("a name comes twice in a family")
        sizes = [max(0, left["n"][k].as_py()) for k in order]
        cells = [(number[x], i, number[y], j, p) for x, i, y, j, p in zip(*(right[c].to_pylist() for c in ("x", "i", "y", "j", "p")), strict=True)]
        column = annealed(Family(sizes, cells), gap_factor=gap_factor, sweeps=sweeps, seed=seed)
        fam = left["fam"][0].as_py() if len(names) else None
        name = np.repeat([names[k] for k in order], sizes)
        pos = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.zeros(0, int)
        return pa.table({"fam": pa.array([fam] * len(column), pa.int64()), "name": pa.array(name, pa.int64()), "pos": pa.array(pos, pa.int32()), "col": pa.array(column, pa.int32())})

    return lengths.groupBy("fam").cogroup(posteriors.select("fam", "x", "i", "y", "j", "p").groupBy("fam")).applyInArrow(run, "fam long, name long, pos int, col int")


def annealed_members(members: DataFrame, patterns: Callable[[], families.Patterns], **how) -> DataFrame:
    """``annealed_families`` of members (fam, name, seq) whose pairs have the cells that ``patterns`` finds.

    Families of one block are aligned where their pairs are made, many in a batch; larger ones are a task's group each.
    """
    made = families.blocks(members)
    small = families.aligned(made, patterns, lambda lengths, a, b, p: annealed(Family.of(lengths, a, b, p), **how))
    rest = made.where("not whole")
    return small.unionByName(annealed_families(families.members(rest), families.pair_cells(rest, patterns), **how))
