"""Pairs of a family's members, made in tasks from blocks of members instead of travelling as rows.

A family's members come in blocks of bounded size; a task makes the pairs within a block, or of two blocks
of one family, and handles each pattern of them once.  Where all residues are alike to a model, a pair's pattern is which of
its residues are equal; else it is the residues themselves.  Families of one block are whole in a row, so that a
batch holds many; others go by all of their pairs of blocks, dealt out evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

MEMBERS, RESIDUES = 64, 512  # of a block, about
TASK_MEMBERS = 1 << 16
PAIRS = 1 << 17  # handled at once, but for a row that alone has more
CELLS = 1 << 24  # compared at once
KNOWN = 1 << 16  # patterns of at most 64 cells that a task remembers


def alike(single: np.ndarray, *tables: np.ndarray) -> bool:
    """Whether all residues have one weight, and each table one entry for equal residues and one for different ones."""
    return bool((single == single[0]).all()) and all((t.diagonal() == t[0, 0]).all() and (t[~np.eye(len(t), dtype=bool)] == t[0, -1]).all() for t in tables)


def blocks(members: DataFrame, most: int = MEMBERS, residues: int = RESIDUES) -> DataFrame:
    """fam, part, parts, whole, m: members (fam, name, seq) as arrays m of (name, seq) by name; ``whole`` where that is a family with each name once; stored."""
    seq = F.coalesce(F.col("seq").cast("array<int>"), F.array().cast("array<int>"))
    rows = stored(members.select("fam", "name", seq.alias("seq")), "members")
    sizes = rows.groupBy("fam").agg(F.ceil(F.greatest(F.count("*") / most, F.sum(F.size("seq")) / residues)).alias("parts")).where("parts > 1")
    dealt = rows.join(sizes.withColumnRenamed("fam", "_f"), F.expr("fam <=> _f"), "left").select("fam", "name", "seq", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("name"), "parts")).otherwise(F.lit(0)))
    tasks = max(-(-rows.count() // TASK_MEMBERS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = dealt.repartition(tasks, "fam", "part").groupBy("fam", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("name", "seq"))).alias("m"))
    whole = (F.col("parts") == 1) & (F.size(F.array_distinct("m.name")) == F.size("m"))
    return stored(made.select("fam", "part", "parts", whole.alias("whole"), "m"), "blocks")


def tiles(made: DataFrame) -> DataFrame:
    """fam, m, n: blocks (n null) and all pairs of different blocks of a family, which are dealt out evenly."""
    own = made.select("fam", "m", F.lit(None).cast(made.schema["m"].dataType).alias("n"))
    large = made.where("parts > 1").select("fam", "part", "m")
    other = large.select("fam", F.col("part").alias("other"), F.col("m").alias("n"))
    tasks = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionAll(large.join(other, "fam").where("part < other").repartition(tasks, "fam", "part", "other").select("fam", "m", "n"))


class Batch:
    """Rows of (fam, m) or (fam, m, n): all members one after another, and the pairs x < y of each row by name, as numbers of members."""

    def __init__(self, batch: pa.RecordBatch):
        self.fam = batch["fam"]
        parts = [_members(batch[c]) for c in ("m", "n") if c in batch.schema.names]
        names, lengths, values = ([p[k] for p in parts] for k in range(3))
        self.names, self.lengths, self.values = np.concatenate(names), np.concatenate(lengths), np.concatenate(values)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.size = parts[0][3]
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        more = parts[1][3] if len(parts) > 1 else np.zeros_like(self.size)
        after = len(names[0]) + np.concatenate([[0], np.cumsum(more)])
        comparable = batch["fam"].is_valid().to_numpy(zero_copy_only=False)
        rows, xs, ys = [], [], []
        for a, b in sorted(set(zip(self.size.tolist(), more.tolist(), strict=True))):
            own = np.flatnonzero((self.size == a) & (more == b) & comparable)
            i, j = (v.ravel() for v in np.indices((a, b))) if b else np.triu_indices(a, 1)
            rows.append(np.repeat(own, len(i)))
            xs.append((self.start[own, None] + i).ravel())
            ys.append(((after if b else self.start)[own, None] + j).ravel())
        row, x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (rows, xs, ys))
        swap = self.names[x] > self.names[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        order = np.argsort(row, kind="stable")
        order = order[self.names[x[order]] != self.names[y[order]]]
        self.row, self.x, self.y = row[order], x[order], y[order]


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, lengths, residues, members of each row) of an array of lists of (name, seq)."""
    flat = column.flatten()
    name, seq = pc.struct_field(flat, "name"), pc.struct_field(flat, "seq")
    count = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return name.to_numpy(zero_copy_only=False).astype(np.int64), count(seq), seq.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count(column)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Rows in batches of about ``PAIRS`` pairs."""
    for batch in rows:
        sizes = [pc.fill_null(pc.list_value_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "n") if c in batch.schema.names]
        pairs = sizes[0] * (sizes[0] - 1) // 2 if len(sizes) == 1 else np.where(sizes[1] > 0, sizes[0] * sizes[1], sizes[0] * (sizes[0] - 1) // 2)
        total, at = np.concatenate([[0], np.cumsum(pairs)]), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            yield Batch(batch.slice(at, end - at))
            at = end


def _named(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences whose equal residues are ``same``: shared ones are numbered as they come in the first, then what is in one only."""
    a, b = same.shape
    x, y = np.zeros(a, np.int64), np.zeros(b, np.int64)
    if not a or not b:
        return x, y
    shared, other = same.any(1), same.any(0)
    _, at, number = np.unique(same.argmax(1)[shared], return_index=True, return_inverse=True)
    x[shared] = np.argsort(np.argsort(at))[number]
    x[~shared] = len(at)
    y[other] = x[same.argmax(0)[other]]
    y[~other] = len(at) + (not shared.all())
    return x, y


class Patterns:
    """What ``solve`` gives for pairs (a frame of x and y) in their order, found once for each pattern of a batch; short patterns are remembered for later ones.

    With ``plain`` a pattern is which residues of a pair are equal.
    """

    def __init__(self, solve: Callable[[pd.DataFrame], list], plain: bool):
        self.solve, self.plain, self.known = solve, plain, {}

    def __call__(self, batch: Batch) -> tuple[list, np.ndarray]:
        """(results, number of each pair's result)."""
        lx, ly = batch.lengths[batch.x], batch.lengths[batch.y]
        order = np.lexsort((ly, lx))
        ends = [*(np.flatnonzero((np.diff(lx[order]) != 0) | (np.diff(ly[order]) != 0)) + 1).tolist(), len(order)]
        if len(self.known) > KNOWN:
            self.known = {}
        results, number, which, begin = [], {}, np.zeros(len(order), np.int64), 0
        new, xs, ys = [], [], []
        for end in ends:
            while begin < end:
                a, b = int(lx[order[begin]]), int(ly[order[begin]])
                rows = order[begin : min(end, begin + max(1, CELLS // max(1, a * b)))]
                begin += len(rows)
                x = batch.values[batch.first[batch.x[rows], None] + np.arange(a)]
                y = batch.values[batch.first[batch.y[rows], None] + np.arange(b)]
                same = x[:, :, None] == y[:, None] if self.plain else None
                key = np.packbits(same.reshape(len(rows), a * b), axis=1) if self.plain else np.concatenate([x, y], 1).view(np.uint8)
                if not key.shape[1]:
                    key = np.zeros((len(rows), 1), np.uint8)
                if key.shape[1] <= 8:
                    key = np.pad(key, ((0, 0), (0, 8 - key.shape[1])))
                flat = np.ascontiguousarray(key).view(np.uint64 if key.shape[1] == 8 else f"V{key.shape[1]}").ravel()
                _, at, back = np.unique(flat, return_index=True, return_inverse=True)
                own = np.zeros(len(at), np.int64)
                for k, r in enumerate(at.tolist()):
                    name = a, b, flat[r].tobytes()
                    if name not in number:
                        number[name] = len(results)
                        results.append(self.known.get(name))
                        if results[-1] is None:
                            new.append(name)
                            one = _named(same[r]) if self.plain else (x[r], y[r])
                            xs.append(one[0])
                            ys.append(one[1])
                    own[k] = number[name]
                which[rows] = own[back.ravel()]
        if new:
            frame = pd.DataFrame({"x": pd.Series(xs, dtype=object), "y": pd.Series(ys, dtype=object)})
            for name, found in zip(new, self.solve(frame), strict=True):
                results[number[name]] = found
                if name[0] * name[1] <= 64:
                    self.known[name] = found
        return results, which


def cells(batch: Batch, found: list, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, i, j, p) of all pairs of a batch whose patterns have the cells ``found`` (i, j, p each)."""
    size = np.array([len(f[0]) for f in found], np.int64)
    start = np.cumsum(size) - size
    i, j, p = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
    n = size[which] if len(which) else np.zeros(0, np.int64)
    pair = np.repeat(np.arange(len(which)), n)
    at = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(len(pair)) if len(pair) else np.zeros(0, np.int64)
    return pair, i[at].astype(np.int64), j[at].astype(np.int64), p[at]


class Order:
    """Columns of residues (numbered through, of sequences of ``lengths``) under way, kept in an order that agrees with all sequences.

    Two columns merge unless one must come before the other; that is searched for only between their two places.
    """

    def __init__(self, lengths: list[int]):
        self.member = [m for m, n in enumerate(lengths) for _ in range(n)]
        n = len(self.member)
        #: of each residue, whether its sequence goes on before and after it
        self.more = {-1: [k > 0 for m in lengths for k in range(m)], 1: [k < m - 1 for m in lengths for k in range(m)]}
        self.residues = [[k] for k in range(n)]
        self.column = list(range(n))
        self.place = list(range(n))
        self.has = [1 << m for m in self.member]  # members as bits

    def _between(self, begin: int, end: int, step: int) -> set[int] | None:
        """What can be reached from ``begin`` in one direction without passing ``end``'s place; None if ``end`` itself can."""
        seen, todo, last = {begin}, [begin], self.place[end] * step
        more, column, place = self.more[step], self.column, self.place
        while todo:
            for r in self.residues[todo.pop()]:
                if more[r]:
                    c = column[r + step]
                    if c == end:
                        return None
                    if place[c] * step < last and c not in seen:
                        seen.add(c)
                        todo.append(c)
        return seen

    def merge(self, a: int, b: int) -> bool:
        """Merges column b into a unless one must come before the other."""
        place = self.place
        low, high = (a, b) if place[a] < place[b] else (b, a)
        after = self._between(low, high, 1)
        if after is None:
            return False
        before = self._between(high, low, -1)
        places = sorted([place[c] for c in after] + [place[c] for c in before])
        # all before the merged column, it, and all after it, in the places they take up together
        for c, at in zip(sorted(before - {high}, key=place.__getitem__), places, strict=False):
            place[c] = at
        kept = places[len(before) - 1]
        for c, at in zip(sorted(after - {low}, key=place.__getitem__), places[len(places) - len(after) + 1 :], strict=True):
            place[c] = at
        place[a] = kept
        for r in self.residues[b]:
            self.column[r] = a
        self.residues[a] += self.residues[b]
        self.residues[b] = []
        self.has[a] |= self.has[b]
        return True


CELL = "fam long, x long, i int, y long, j int, p double"
RESIDUE = "fam long, name long, pos int, col int"


def pair_cells(made: DataFrame, patterns: Callable[[], Patterns]) -> DataFrame:
    """fam, x, i, y, j, p of every two members of the families in blocks ``made``."""

    def run(rows):
        solver = patterns()
        for batch in batches(rows):
            pair, i, j, p = cells(batch, *solver(batch))
            name = lambda v: pa.array(batch.names[v[pair]])  # noqa: B023, E731
            fam = batch.fam.take(pa.array(batch.row[pair])).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([fam, name(batch.x), pa.array(i, pa.int32()), name(batch.y), pa.array(j, pa.int32()), pa.array(p, pa.float64())], names=["fam", "x", "i", "y", "j", "p"])

    return tiles(made).mapInArrow(run, CELL)


def aligned(made: DataFrame, patterns: Callable[[], Patterns], align: Callable[[list, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """fam, name, pos, col of the families that are whole in a row of ``made``: ``align`` gets lengths and cells (residue, residue, p), residues numbered through."""

    def run(rows):
        solver = patterns()
        for batch in batches(rows):
            pair, i, j, p = cells(batch, *solver(batch))
            a, b, row = batch.first[batch.x[pair]] + i, batch.first[batch.y[pair]] + j, batch.row[pair]
            cut = np.searchsorted(row, np.arange(len(batch.size) + 1)).tolist()
            column = []
            for k, (lo, hi) in enumerate(zip(batch.start[:-1].tolist(), batch.start[1:].tolist(), strict=True)):
                own, base = slice(cut[k], cut[k + 1]), batch.first[lo]
                column.append(align(batch.lengths[lo:hi].tolist(), a[own] - base, b[own] - base, p[own]))
            col = np.concatenate(column) if column else np.zeros(0)
            n = batch.lengths
            pos = np.arange(len(col)) - np.repeat(batch.first[:-1], n)
            fam = batch.fam.take(pa.array(np.repeat(np.repeat(np.arange(len(batch.size)), batch.size), n))).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([fam, pa.array(np.repeat(batch.names, n)), pa.array(pos, pa.int32()), pa.array(col, pa.int32())], names=["fam", "name", "pos", "col"])

    return made.where("whole").select("fam", "m").mapInArrow(run, RESIDUE)


def members(made: DataFrame) -> DataFrame:
    """The members (fam, name, seq) of blocks."""
    return made.select("fam", F.inline("m"))
