"""Pairs made in tasks from blocks of members: as many as rows would be, patterns handled once, families whole or in blocks alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import storage
from stemma.operators import decoding, families, pair_times, pairwise, substitution

MODEL = pair_times.Model(0.03, 0.05, 0.4, *substitution.equal_rates(4))
SCHEMA = "fam long, name long, seq array<int>"


def drawn(seed=3, fams=6, most=9):
    rng = np.random.default_rng(seed)
    rows = [(f, 10 * k + f, rng.integers(0, 4, rng.integers(0, 6)).tolist()) for f in range(fams) for k in range(rng.integers(1, most))]
    return [*rows, (None, 1, [1]), (None, 2, [1]), (7, 3, None), (7, 4, [0, 1])]


def plain(rows, model):
    """Each pair on its own."""
    pairs = [(f, a, b, x or [], y or []) for f, a, x in rows for g, b, y in rows if f is not None and f == g and a < b]
    out = {}
    for f, a, b, x, y in pairs:
        t = np.array([1.0])
        stack = np.array([x], int).reshape(1, -1), np.array([y], int).reshape(1, -1), np.array([len(x)]), np.array([len(y)])
        _, steps, matches, _ = pair_times.expectations(model.tables(t, *stack), len(model.pi))
        out[f, a, b] = float(pair_times.newton(model, t, steps, matches, 5)[0])
    return out


def test_distances_are_those_of_each_pair(spark):
    rows = drawn()
    found = {(r.fam, r.x, r.y): r.d for r in pair_times.distances(spark.createDataFrame(rows, SCHEMA), MODEL).collect()}
    want = plain(rows, MODEL)
    assert len(want) > 50 and set(found) == set(want)
    assert all(found[k] == pytest.approx(v, rel=1e-5) for k, v in want.items())


def test_residues_that_differ_in_weight_are_kept_apart(spark):
    pi = np.array([0.4, 0.3, 0.2, 0.1])
    model = pair_times.Model(0.03, 0.05, 0.4, substitution.rate_matrix(np.ones((4, 4)), pi), pi)
    assert families.alike(MODEL.pi, MODEL.q) and not families.alike(model.pi, model.q)
    rows = [(1, k, [k % 4] * (1 + k // 4)) for k in range(8)]
    found = {(r.fam, r.x, r.y): r.d for r in pair_times.distances(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert found == pytest.approx(plain(rows, model), rel=1e-5) and len(set(found.values())) > 20


@pytest.mark.parametrize("most", [2, 3, 64])
def test_blocks_make_every_pair_once(spark, most):
    rows = drawn()
    made = families.blocks(spark.createDataFrame(rows, SCHEMA), most)
    assert {(r.fam, r.name) for r in families.members(made).collect()} == {r[:2] for r in rows}
    cells = families.pair_cells(made, lambda: pair_times.member_cells(MODEL, 0.0)).groupBy("fam", "x", "y").count().collect()
    size = {r[:2]: len(r[2] or []) for r in rows}
    assert {(r.fam, r.x, r.y): r["count"] for r in cells} == {k: size[k[0], k[1]] * size[k[0], k[2]] for k in plain(rows, MODEL) if size[k[0], k[1]] * size[k[0], k[2]]}


def test_pairs_are_not_written_as_rows(spark):
    """60 members have 1,770 pairs; what is written is the members, and their blocks."""
    members = spark.range(60).select(F.lit(1).cast("long").alias("fam"), F.col("id").alias("name"), F.array(F.col("id").cast("int") % 4).alias("seq"))
    written, own = [], storage.scratch
    storage.scratch = lambda *a: written.append(own(*a)) or written[-1]
    try:
        assert pair_times.distances(members, MODEL).count() == 1770
    finally:
        storage.scratch = own
    assert sum(spark.read.parquet(w).count() for w in written) <= 60 + 4


def test_a_pattern_is_solved_once():
    """Of 3,000 pairs of up to two residues there are few patterns; all pairs of one have one result."""
    import pyarrow as pa

    rng, solved = np.random.default_rng(1), []
    rows = [[(k, rng.integers(0, 20, rng.integers(1, 3)).tolist()) for k in range(25)] for _ in range(10)]
    kind = pa.list_(pa.struct([("name", pa.int64()), ("seq", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(rows, kind)], names=["fam", "m"])
    same = lambda x, y: tuple((np.asarray(x)[:, None] == np.asarray(y)).ravel().tolist())
    solver = families.Patterns(lambda pdf: solved.extend(zip(pdf["x"], pdf["y"], strict=True)) or [(len(x), len(y), same(x, y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)], True)
    for _ in range(2):
        for b in families.batches(iter([batch])):
            found, which = solver(b)
            assert len(which) == 3000
            for x, y, k in zip(b.x, b.y, which, strict=True):
                u, v = (b.values[b.first[m] : b.first[m + 1]] for m in (x, y))
                assert found[k] == (len(u), len(v), same(u, v))
    assert len(solved) == len(set(map(str, solved))) <= 2 + 4 + 4 + 12


def searched(lengths, a, b, p, threshold):
    """Columns by merging from the strongest cell down, each search over all that comes after."""
    member = [m for m, n in enumerate(lengths) for _ in range(n)]
    nodes = range(len(member))
    group, columns = list(nodes), {k: [k] for k in nodes}
    after = lambda c: {group[r + 1] for r in columns[c] if r + 1 in nodes and member[r + 1] == member[r]}

    def reaches(u, v):
        todo, seen = list(after(u)), set()
        while todo:
            c = todo.pop()
            if c == v:
                return True
            if c not in seen:
                seen.add(c)
                todo += after(c)
        return False

    for q, u, v in sorted(zip((-p).tolist(), a.tolist(), b.tolist(), strict=True)):
        u, v = group[u], group[v]
        if -q < threshold or u == v or {member[r] for r in columns[u]} & {member[r] for r in columns[v]} or reaches(u, v) or reaches(v, u):
            continue
        for r in columns[v]:
            group[r] = u
        columns[u] += columns.pop(v)
    out, left = [0] * len(member), set(columns)
    for number in range(len(columns)):
        c = min(c for c in left if not any(c in after(o) for o in left))
        left.remove(c)
        for r in columns[c]:
            out[r] = number
    return out


@pytest.mark.parametrize("seed", range(20))
def test_merges_are_those_of_a_whole_search(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 6, 6).tolist()
    first = np.cumsum([0, *lengths])
    cells = [(first[x] + i, first[y] + j, float(rng.integers(1, 20)) / 20) for x in range(6) for y in range(x + 1, 6) for i in range(lengths[x]) for j in range(lengths[y]) if rng.random() < 0.5]
    a, b, p = (np.array([c[k] for c in cells]) for k in range(3))
    assert decoding.strongest_first(lengths, a, b, p, 0.2).tolist() == searched(lengths, a, b, p, 0.2)


def test_whole_families_need_no_group(spark, monkeypatch):
    """Families of one block are aligned in batches of rows; as groups they are aligned alike."""
    rows = [r for r in drawn(5, 8, 7) if r[0] is not None]
    members, model = spark.createDataFrame(rows, SCHEMA), pairwise.model_arrays(0.03, 0.05, 1.0, 0.4, 4)
    grouped, own = [], decoding.merged_columns
    monkeypatch.setattr(decoding, "merged_columns", lambda cells, threshold, m: grouped.append(m.count()) or own(cells, threshold, m))
    made = lambda: sorted(map(tuple, decoding.aligned_families(members, *model, threshold=0.3).collect()))
    whole = made()
    assert len(whole) == sum(len(r[2] or []) for r in rows) and grouped == [0]
    blocks = families.blocks
    monkeypatch.setattr(families, "blocks", lambda m: blocks(m, 2))
    assert made() == whole and grouped[1] > len(rows) / 2
