import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemma.functions import expressions as X
from stemma.operators import counts, markov, metrics, mixture, pairwise, paths, phylogeny, relations, trees
from stemma.plans import registry

SMALL = "/root/testdata/sf0.001"


def frame(spark, pairs):
    """Columns of pairs given as strings of M, I and D; residues are the positions."""
    return spark.createDataFrame([(k, p, "MID".index(s) + 1, p % 20, (p + k) % 20) for k, path in pairs.items() for p, s in enumerate(path)], "pair_id long, pos long, st int, a int, b int")


def found(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_transitions_and_run_lengths(spark):
    cols = frame(spark, {1: "MDMIM", 2: "MMMIMDD"})
    groups = spark.createDataFrame([(1, 0), (2, 0)], "pair_id long, g int")
    n = found(counts.transition_counts(cols, groups, ["g"]), "src", "dst", "n")
    assert n[0, 1] == 2 and n[1, 3] == 2 and n[3, 1] == 1 and n[1, 2] == 2 and n[2, 1] == 2 and n[1, 4] == 1 and n[3, 4] == 1 and sum(n.values()) == 14
    assert found(paths.run_lengths(cols), "pair_id", "rle") == {(1,): "M1D1M1I1M1", (2,): "M3I1M1D2"}
    back = paths.run_lengths(cols).select("pair_id", paths.run_states(F.col("rle")).alias("s")).collect()
    assert {r.pair_id: r.s for r in back} == {1: [1, 3, 1, 2, 1], 2: [1, 1, 1, 2, 1, 3, 3]}


def test_gap_kinds(spark):
    n = found(counts.gap_tally(frame(spark, {1: "DI", 2: "IM", 3: "M", 4: "MDDDDM"}), 3), "kind", "i", "j", "n")
    assert n == {("SE", 1, 1): 1, ("SM", 0, 1): 1, ("ME", 0, 0): 3, ("SM", 0, 0): 2, ("MM", 3, 0): 1}


def test_adjacency_symmetry(spark):
    cols = frame(spark, {1: "MDI", 2: "IM"})
    both = found(counts.adjacency_counts(cols, symmetric=True), "key", "a1", "b1", "a2", "b2", "n")
    flip = str.maketrans("ID", "DI")
    assert all(both[k.translate(flip), b1, a1, b2, a2] == n for (k, a1, b1, a2, b2), n in both.items())
    assert sum(both.values()) == 2 * sum(found(counts.adjacency_counts(cols), "key", "a1", "b1", "a2", "b2", "n").values())


def test_link_matrix_rows_sum_to_one(spark):
    rates = spark.createDataFrame([(0.03, 0.05, 1.0), (0.05, 0.05, 0.7), (0.2, 0.21, 3.0)], "l double, m double, t double")
    for ext in (None, F.lit(0.4), F.lit(0.0)):
        p = X.link_transitions(F.col("l"), F.col("m"), F.col("t"), ext)
        for src in "SMID":
            for r in rates.select(sum((p[src, d] for d in "ID"), p[src, "M"]) + p[src, "E"]).collect():
                assert abs(r[0] - 1) < 1e-12
    beta = rates.where("l = m").select(X.birth_death(F.col("l"), F.col("m"), F.col("t"))["beta"]).first()[0]
    assert abs(beta - 0.035 / 1.035) < 1e-12


def test_times_and_bins(spark):
    p = spark.createDataFrame([(0.0,), (0.3,), (0.96,), (1.0,)], "p double").select(X.poisson_time(F.col("p"))).collect()
    assert [round(r[0], 6) for r in p] == [0.0, round(-math.log(1 - 0.3 * 20 / 19), 6), 5.0, 5.0]
    edges = [1.0, 2.0, 4.0, 8.0]
    got = spark.createDataFrame([(0.5,), (2.0,), (4.0,), (9.0,), (None,)], "x double").select(X.bin_left_open(F.col("x"), edges), X.bin_right_open(F.col("x"), edges)).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (1, 2), (2, 2), (None, None)]


def test_quadratic_rates_are_a_maximum(spark):
    b, d, s, n, e, t = 5.0, 30.0, 40.0, 20.0, 4.0, 8.0
    lam, mu = spark.range(1).select(*X.quadratic_rates(*map(F.lit, (b, d, s, n, e, t)))).first()
    score = lambda x, y: b * math.log(x) + d * math.log(y) - x * (s + t) - y * s + n * math.log(x / y) + e * math.log(1 - x / y)
    assert 0 < lam < mu and all(score(lam, mu) >= score(lam * f, mu * g) for f in (0.99, 1, 1.01) for g in (0.99, 1, 1.01))


def test_em_never_lowers_the_likelihood(spark):
    groups = registry.log_parameter_groups(spark, SMALL).toPandas()

    def loglik(lam, mu):
        total = 0
        for r in groups.itertuples():
            t = (registry.EDGES[r.tau_bin] * registry.EDGES[r.tau_bin + 1]) ** 0.5
            alpha, x = math.exp(-mu * t), math.exp((lam - mu) * t)
            beta, kappa = lam * (1 - x) / (mu - lam * x), lam / mu
            gamma = 1 - beta / (kappa * (1 - alpha))
            for n, p in ((r.n_alpha, alpha), (r.n_1malpha, 1 - alpha), (r.n_beta, beta), (r.n_1mbeta, 1 - beta), (r.n_gamma, gamma), (r.n_1mgamma, 1 - gamma), (r.n_kappa, kappa), (r.n_1mkappa, 1 - kappa)):
                total += n * math.log(p)
        return total

    trace = [loglik(0.03, 0.05), *(loglik(r.lam, r.mu) for r in registry.link_rates_em(spark, SMALL).orderBy("iteration").collect())]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(trace))


def test_mixture_em_never_lowers_the_likelihood(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, [float(x) for x in rng.normal((i % 2) * 3, 1, 2)]) for i in range(60)], "vec_id long, embedding array<double>")
    _, logw, trace = mixture.gaussian_em(points, 2, 2, iterations=4)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(trace)) and abs(sum(map(math.exp, logw)) - 1) < 1e-9


def test_forward_and_viterbi_against_all_paths(spark):
    start, trans, emit = registry.HMM
    xs = [[], [0], [2, 1, 0], [1, 1, 2, 0, 2]]
    df = spark.createDataFrame(list(enumerate(xs)), "k int, xs array<int>")
    f = {r.k: r.loglik for r in markov.forward(df, start, trans, emit).collect()}
    v = {r.k: r.score for r in markov.viterbi(df, start, trans, emit).collect()}
    for k, x in enumerate(xs):
        ps = [math.prod([start[p[0]], *(trans[a][b] for a, b in itertools.pairwise(p)), *(emit[s][o] for s, o in zip(p, x, strict=True))]) for p in itertools.product(range(2), repeat=len(x))] if x else [1.0]
        assert abs(f[k] - math.log(sum(ps))) < 1e-9 and abs(v[k] - math.log(max(ps))) < 1e-9


def every_path(lx, ly):
    if not lx and not ly:
        yield ""
    for s, dx, dy in (("M", 1, 1), ("I", 0, 1), ("D", 1, 0)):
        if lx >= dx and ly >= dy and (lx or ly) and not (dx > lx or dy > ly):
            for rest in every_path(lx - dx, ly - dy):
                yield s + rest


@pytest.mark.parametrize("x,y", [([], []), ([1], []), ([], [2, 1]), ([0, 1, 2], [1, 2]), ([3, 3], [3, 3, 0])])
def test_pair_model_against_all_alignments(x, y):
    trans, emit, single = pairwise.model_arrays(0.3, 0.5, 0.8, 0.2, 4)
    total, match = 0.0, np.zeros((len(x), len(y)))
    for path in every_path(len(x), len(y)):
        p, i, j, prev, hits = 1.0, 0, 0, 0, []
        for s in path:
            k = "MID".index(s) + 1
            p *= trans[prev, k] * (emit[x[i], y[j]] if k == 1 else single[y[j]] if k == 2 else single[x[i]])
            hits += [(i, j)] if k == 1 else []
            i, j, prev = i + (k != 2), j + (k != 3), k
        p *= trans[prev, 4]
        total += p
        for h in hits:
            match[h] += p
    f, b, got = pairwise.pair_tables(trans, emit, single, np.array([x], int).reshape(1, -1), np.array([y], int).reshape(1, -1))
    assert abs(got[0] - math.log(total)) < 1e-9
    if x and y:
        assert np.allclose(np.exp(f[1:, 1:, 0] + b[1:, 1:, 0] - got)[..., 0], match / total)


def test_global_alignment(spark):
    pairs = spark.createDataFrame([(1, [1, 2, 3], [1, 3]), (2, [], [5]), (3, [], []), (4, [4], [4])], "pair_id long, x array<int>, y array<int>")
    got = {r.pair_id: (r.score, round(r.identity, 3), r.states) for r in pairwise.global_alignment(pairs).collect()}
    assert got == {1: (1.0, 0.667, "MDM"), 2: (-1.0, 0.0, "I"), 3: (0.0, 0.0, ""), 4: (1.0, 1.0, "M")}


def test_neighbour_joining_recovers_an_additive_tree(spark):
    legs = {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}
    d = {(x, y): legs[x] + legs[y] + (5.0 if (x in (1, 2)) != (y in (1, 2)) else 0.0) for x in legs for y in legs if x < y}
    table = spark.createDataFrame([(7, x, y, v) for (x, y), v in d.items()], "fam long, x long, y long, d double")
    rows = phylogeny.neighbour_joining(table).collect()
    leaf = {r.name: r for r in rows if r.name is not None}
    assert {k: round(r.length, 9) for k, r in leaf.items()} == legs
    assert leaf[1].parent == leaf[2].parent or leaf[3].parent == leaf[4].parent
    up = {r.node: (r.parent, r.length) for r in rows}
    closure = lambda n: [(n, 0.0)] + ([(a, s + up[n][1]) for a, s in closure(up[n][0])] if up[n][0] is not None else [])
    for (x, y), v in d.items():
        a, b = dict(closure(leaf[x].node)), dict(closure(leaf[y].node))
        assert abs(min(a[k] + b[k] for k in a.keys() & b.keys()) - v) < 1e-9


def test_average_linkage_and_matching(spark):
    table = spark.createDataFrame([(1, 1, 2, 2.0), (1, 1, 3, 6.0), (1, 2, 3, 8.0)], "fam long, x long, y long, d double")
    rows = {r.name: r for r in phylogeny.average_linkage(table).collect() if r.name is not None}
    assert rows[1].length == 1.0 and rows[2].length == 1.0 and rows[3].length == 3.5
    assert [(r.x, r.y) for r in phylogeny.greedy_matching(table).collect()] == [(1, 2)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_trees_and_matching_have_every_vector(spark):
    vectors = {r.vec_id: (r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rows = registry.QUERIES["average_linkage_trees"](spark, SMALL).collect()
    for tree in (rows, registry.QUERIES["neighbour_joining_trees"](spark, SMALL).collect()):
        assert sorted(r.name for r in tree if r.name is not None) == sorted(vectors)
    child = {(r.fam, r.parent): r for r in rows}
    height = lambda r: child[r.fam, r.node].length + height(child[r.fam, r.node]) if r.name is None else 0.0
    matched = registry.QUERIES["greedy_matching"](spark, SMALL).collect()
    for fam in {label for label, _ in vectors.values()}:
        ids = sorted(k for k, (label, _) in vectors.items() if label == fam)
        d = {(a, b): float(np.linalg.norm(vectors[a][1] - vectors[b][1])) for a, b in itertools.combinations(ids, 2)}
        used, want = set(), []
        for a, b in sorted(d, key=lambda p: (d[p], p)):
            if not {a, b} & used:
                used |= {a, b}
                want.append((a, b))
        assert sorted((r.x, r.y) for r in matched if r.fam == fam) == sorted(want)
        clusters, joined = [(k,) for k in ids], []
        apart = lambda p: sum(d[min(a, b), max(a, b)] for a in p[0] for b in p[1]) / len(p[0]) / len(p[1])  # noqa: B023, E731
        while len(clusters) > 1:
            a, b = min(itertools.combinations(clusters, 2), key=apart)
            joined.append(apart((a, b)) / 2)
            clusters = [c for c in clusters if c not in (a, b)] + [a + b]
        assert np.allclose(sorted(height(r) for r in rows if r.fam == fam and r.name is None), joined)


def test_rounds_over_tables_equal_one_matrix(spark):
    rng = np.random.default_rng(4)
    points = [(f, 100 * f + k, [float(v) for v in (rng.integers(0, 3, 2) if f == 1 else rng.random(5))]) for f in (1, 2) for k in range(25)]  # the first family has many equal distances
    df = spark.createDataFrame(points, "fam long, vec_id long, embedding array<double>")
    for f in (phylogeny.average_linkage, phylogeny.greedy_matching):
        tidy = lambda out: sorted(tuple(round(v, 9) if isinstance(v, float) else -1 if v is None else v for v in r) for r in out.collect())
        whole = tidy(f(df))
        assert whole == tidy(f(df, limit=12)) == tidy(f(phylogeny.vector_distances(df), limit=12))


def test_neighbour_joining_looks_at_few_rows(monkeypatch):
    class Seen(np.ndarray):
        def __getitem__(self, at):
            looked.append(len(at[0]))
            return np.asarray(super().__getitem__(at))

    class Rows:  # a table of one family, so that rows are counted in this process
        groupBy = select = distinct = lambda self, *_: self
        columns = ["fam", "vec_id", "embedding"]
        count = lambda self: 1
        applyInPandas = lambda self, f, _: f((1,), table)

    looked, found = [], phylogeny._least_pair
    v = np.random.default_rng(12).normal(size=(400, 64))
    table = pd.DataFrame({"fam": 1, "vec_id": range(400), "embedding": list(v / np.linalg.norm(v, axis=1, keepdims=True))})
    monkeypatch.setattr(phylogeny, "_least_pair", lambda d, *rest: found(d.view(Seen), *rest))
    monkeypatch.setattr(phylogeny, "_apart", lambda rows, *_: rows, raising=False)
    assert len(phylogeny.neighbour_joining(Rows())) == 400 + 398
    assert sum(looked) < 400 * 400 / 2 / 4


def test_matching_by_lists_equals_the_matrix(spark):
    rng = np.random.default_rng(9)
    kinds = [rng.random((90, 6)), rng.integers(0, 3, (90, 2)).astype(float), np.repeat(rng.random((31, 3)), 3, 0), 1e8 + rng.random((60, 4)), np.cumsum(1.5 ** np.arange(40))[:, None], np.zeros((9, 2)), np.eye(70)]
    rows = [(f, 1000 * f + 3 * k, [float(c) for c in v]) for f, vs in enumerate(kinds) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "fam long, vec_id long, embedding array<double>")
    tidy = lambda out: sorted(map(tuple, out.collect()))
    want = tidy(phylogeny.greedy_matching(phylogeny.vector_distances(df)))
    assert len(want) == sum(len(vs) // 2 for vs in kinds)
    assert want == tidy(phylogeny.greedy_matching(df)) == tidy(phylogeny.greedy_matching(df, limit=20))


def test_tiles_find_the_nearest_members(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "fam long, vec_id long, embedding array<double>")
    got = sorted(map(tuple, phylogeny.nearest_members(df, 4, block=17).collect()))
    want = []
    for a in range(60):
        near = sorted((float(np.linalg.norm(v[a] - v[b])), min(a, b), max(a, b), b) for b in range(60) if b != a)
        want += [(1, a, b, d) for d, _, _, b in near[:4]]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])


def test_large_families_are_matched_without_pair_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, k, [float(k * k % 101), float(k)]) for k in range(50)], "fam long, vec_id long, embedding array<double>")
    want = sorted(map(tuple, phylogeny.greedy_matching(df).collect()))
    monkeypatch.setattr(phylogeny, "vector_distances", None)
    assert sorted(map(tuple, phylogeny.greedy_matching(df, limit=10).collect())) == want


def test_large_families_are_linked_without_pair_tables(spark, monkeypatch):
    v = np.random.default_rng(11).normal(size=(70, 4)) + 1e4
    df = spark.createDataFrame([(1, 5 * k, x.tolist()) for k, x in enumerate(v)], "fam long, vec_id long, embedding array<double>")
    tidy = lambda out: sorted((r.node, r.parent if r.parent is not None else -1, r.name if r.name is not None else -1, round(r.length, 9)) for r in out.collect())
    want = tidy(phylogeny.average_linkage(df))
    monkeypatch.setattr(phylogeny, "vector_distances", None)
    monkeypatch.setattr(phylogeny, "BLOCK", 20)
    assert tidy(phylogeny.average_linkage(df, limit=15)) == want


def test_neighbour_joining_equals_the_plain_search(spark):
    rng = np.random.default_rng(6)
    d = np.triu(rng.random((14, 14)) + 1, 1)
    d += d.T
    table = spark.createDataFrame([(1, i, j, float(d[i, j])) for i in range(14) for j in range(i + 1, 14)], "fam long, x long, y long, d double")
    got = {r.node: r.parent for r in phylogeny.neighbour_joining(table).collect()}
    alive, dist, want = list(range(14)), {(i, j): d[i, j] for i in range(14) for j in range(14)}, {}
    for new in range(14, 25):
        total = {a: sum(dist[a, b] for b in alive) for a in alive}
        a, b = min(itertools.combinations(alive, 2), key=lambda p: (len(alive) - 2) * dist[p] - total[p[0]] - total[p[1]])
        want |= {a: new, b: new}
        alive = [k for k in alive if k not in (a, b)]
        for k in alive:
            dist[new, k] = dist[k, new] = (dist[a, k] + dist[b, k] - dist[a, b]) / 2
        dist[new, new] = 0.0
        alive.append(new)
    assert got == want | dict.fromkeys(alive, 25) | {25: None}


def test_pruning_sums_over_inner_states(spark):
    edges = spark.createDataFrame([("a", "x", 0.3), ("b", "x", 0.7), ("x", "r", 0.2), ("c", "r", 1.0)], "node string, parent string, length double")
    leaves = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "node string, state int")
    p = lambda t, i, j: (1 - math.exp(-t * 1.5)) / 3 + (math.exp(-t * 1.5) if i == j else 0)
    got = [r for r in phylogeny.pruning(edges, leaves, 3, 1).where("node = 'x'").collect()]
    for s in range(3):
        assert abs(math.exp(got[0][f"l{s}"]) - p(0.3, s, 0) * p(0.7, s, 1)) < 1e-9


def test_parsimony_and_ancestors(spark):
    edges = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("x", "r", 1.0), ("c", "r", 1.0)], "node string, parent string, length double")
    states = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "node string, mask int")
    assert found(trees.parsimony(edges, states, 3), "node", "mask") == {("a",): 1, ("b",): 2, ("c",): 2, ("x",): 3, ("r",): 2}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "x string, y string")
    assert found(trees.path_distances(pairs, trees.ancestors(edges, 2)), "x", "y", "d") == {("a", "b"): 2.0, ("a", "c"): 3.0}


def test_parsimony_is_resolved_from_the_root(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("x", "r"), ("y", "r"), ("z", "r")], "node string, parent string")
    states = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 2)], "node string, mask int")
    sets = trees.parsimony(edges, states, 2, unknown=7)
    assert found(trees.resolved(edges, sets, 2), "node", "mask", "state") == {("a", 1): 1, ("b", 2): 2, ("c", 2): 2, ("d", 2): 2, ("x", 3): 2, ("y", 2): 2, ("z", 7): 2, ("r", 2): 2}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_ancestral_states_reach_the_root(spark):
    rows = registry.QUERIES["ancestral_states"](spark, SMALL).collect()
    total = {}
    for r in rows:
        total[r.node] = total.get(r.node, 0.0) + r.p
    assert {k[0] for k in total} == set("cnr") and "root" in total and all(abs(v - 1) < 1e-9 for v in total.values())


def test_relations(spark):
    rows = spark.createDataFrame([("f", "a", "AC"), ("f", "b", "A-"), ("f", "c", "A")], "fam string, name string, aln string")
    pairs = spark.createDataFrame([("f", "a", "b", 1.0), ("f", "a", "c", 1.0), ("f", "a", "z", 1.0), ("f", "b", "a", 0.0), ("f", "b", "a", float("nan"))], "fam string, name_a string, name_b string, tau double")
    assert relations.guarded_pairs(relations.lookup_pairs(pairs, rows)).count() == 1
    assert [(r.fam, r.name) for r in relations.missing_partners(pairs, rows).collect()] == [("f", "z")]
    d = spark.createDataFrame([("f", "a", "b", 1.0), ("f", "b", "a", 1.0), ("f", "a", "c", 5.0), ("f", "c", "a", 5.0)], "fam string, name string, other string, d double")
    assert relations.held_out_leaf(d).collect()[0].name == "c"


def test_metrics(spark):
    ref = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 0), (1, 1, "a", 1), (1, 1, "b", None)], "g int, col int, name string, pos int")
    test = spark.createDataFrame([(1, 5, "a", 0), (1, 5, "b", 0), (1, 6, "a", 1), (1, 6, "b", 1)], "g int, col int, name string, pos int")
    assert metrics.total_columns(ref, test, ["g"]).collect()[0].tc == 0.5
    ranks = metrics.average_ranks(spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0)], "g int, v double"), "g", "v", "r").orderBy("v").collect()
    assert [r.r for r in ranks] == [1.5, 1.5, 3.0]
    aic = metrics.information_criteria(spark.createDataFrame([("m", -10.0, 2)], "model string, loglik double, k int"), 100).collect()[0]
    assert aic.aic == 24.0 and abs(aic.bic - (20 + 2 * math.log(100))) < 1e-9


def test_running_estimates(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 3.0, 2.0, 2.0, 4.0])], "g int, k int, v double")
    e = paths.moving_average(rows, "g", ["k"], "v", F.lit(0.5), 0.0).orderBy("k").collect()
    s, want = 0.0, []
    for r in e:
        s = 0.5 * s + 0.5 * r.v
        want.append(s)
    assert [r.ema for r in e] == want
    w = paths.decayed_weights(rows.withColumn("eta", F.lit(0.5)), "g", ["k"], "eta").orderBy("k").collect()
    assert [r.weight for r in w] == [0.5**5, 0.5**4, 0.5**3, 0.5**2, 0.5]
    stop = paths.early_stop(rows, "g", ["k"], "v", 2).orderBy("k").collect()
    assert [(r.best, r.wait, r.stop) for r in stop] == [(1.0, 0, False), (3.0, 0, False), (3.0, 1, False), (3.0, 2, True), (4.0, 0, False)]
    assert abs(sum(X.discrete_gamma(0.5, 4)) - 4) < 1e-9


def test_substitution_tables():
    from stemma.operators import substitution as S

    rng = np.random.default_rng(1)
    pi = rng.dirichlet(np.ones(4))
    x = rng.random((4, 4))
    q = S.rate_matrix(x + x.T, pi)
    p = S.transition(q, pi, 0.7)
    step = np.linalg.matrix_power(np.eye(4) + q * 0.7 / 4096, 4096)
    assert np.allclose(p.sum(1), 1) and np.allclose(p, step, atol=1e-3) and np.allclose(pi @ p, pi)
    counts_ = rng.integers(1, 9, (4, 4)).astype(float)
    dwell, jumps = S.expected_statistics(q, pi, 0.7, counts_)
    assert abs(dwell.sum() - 0.7 * counts_.sum()) < 1e-9 and (jumps >= -1e-12).all()
    # changes in and out of a state differ by its end-point counts
    assert np.allclose(jumps.sum(0) - jumps.sum(1), counts_.sum(0) - counts_.sum(1))


def test_brackets(spark):
    from stemma.operators import grammar

    df = spark.createDataFrame([("((.).)",), ("(",), (")(",), ("",), ("..",)], "s string")
    got = {r.s: r.p for r in df.select("s", grammar.partners(F.col("s")).alias("p")).collect()}
    assert got == {"((.).)": [5, 3, -1, 1, -1, 0], "(": None, ")(": None, "": [], "..": [-1, -1]}


def test_optimal_accuracy_against_all_chains():
    from stemma.operators import decoding

    rng = np.random.default_rng(2)
    i, j, p = rng.integers(0, 4, 9), rng.integers(0, 4, 9), rng.random(9)
    rising = lambda c: all(i[a] < i[b] and j[a] < j[b] for a, b in itertools.pairwise(c))
    best = max((sum(p[list(c)]) for n in range(1, 5) for c in itertools.permutations(range(9), n) if rising(c)))
    got = decoding.best_chain(i, j, p)
    assert rising(got) and abs(p[got].sum() - best) < 1e-9


def test_optimal_accuracy_decodes_the_full_posterior(spark, tmp_path):
    from stemma.sources import tables

    rng = np.random.default_rng(8)
    thin = [(1, k, 3, 4, 1.0, "2024-01-01", "A" if k % 2 else "N") for k in range(80)]  # 40 residues against 80 others
    wide = [(2, k, int(rng.integers(20)), int(rng.integers(20)), 1.0, "2024-01-01", "AAANR"[k % 5]) for k in range(50)]
    folder = str(tmp_path)
    spark.createDataFrame(thin + wide, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    model = pairwise.model_arrays(*registry.RATES[:2], 1.0, registry.RATES[2], 20)
    full, sums, low = {}, {}, 1.0
    for r in pairwise.match_posteriors(pairwise.ungapped(tables.columns(spark, folder)), *model, threshold=0.0).collect():
        full.setdefault(r.pair_id, {})[r.i, r.j] = r.p
    for r in registry.QUERIES["optimal_accuracy_alignments"](spark, folder).collect():
        sums[r.pair_id], low = sums.get(r.pair_id, 0.0) + r.p, min(low, r.p)
    assert sums.keys() == full.keys() == {1, 2} and 0 < low < 0.05
    for k, cells in full.items():
        best = {}
        for i in range(max(i for i, _ in cells) + 1):
            for j in range(max(j for _, j in cells) + 1):
                best[i, j] = max(best.get((i - 1, j - 1), 0.0) + cells[i, j], best.get((i - 1, j), 0.0), best.get((i, j - 1), 0.0))
        assert abs(max(best.values()) - sums[k]) < 1e-9


def test_merged_columns(spark):
    from stemma.operators import decoding

    post = spark.createDataFrame([(1, 1, 0, 2, 0, 0.9), (1, 1, 1, 2, 1, 0.8), (1, 1, 1, 2, 0, 0.7), (1, 2, 1, 3, 0, 0.6), (1, 1, 0, 3, 0, 0.55)], "fam long, x long, i int, y long, j int, p double")
    col = {(r.name, r.pos): r.col for r in decoding.merged_columns(post).collect()}
    assert col[1, 0] == col[2, 0] and col[1, 1] == col[2, 1] == col[3, 0] and col[1, 0] < col[1, 1]


def test_samples_follow_the_model(spark):
    from stemma.operators import simulate

    trans, emit, single = pairwise.model_arrays(0.3, 0.5, 0.8, 0.2, 4)
    ids = spark.range(400).withColumnRenamed("id", "pair_id")
    drawn = simulate.alignments(ids, trans, emit, single).cache()
    again = simulate.alignments(ids.repartition(7), trans, emit, single)
    assert sorted(drawn.collect(), key=str) == sorted(again.collect(), key=str)
    first = drawn.where("pos = 0").groupBy("st").count().collect()
    share = {r.st: r["count"] / 400 for r in first}
    assert all(abs(share.get(k, 0) - trans[0, k]) < 0.08 for k in (1, 2, 3))
