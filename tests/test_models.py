"""Decoders, pair models, gaps, cherries and tree surgery against plain restatements on small inputs."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from stemma.functions import expressions as X
from stemma.operators import cherries, counts, gaps, guards, markov, pairwise, trees
from stemma.plans import registry

from .test_operators import every_path, frame


def test_decoding_against_all_paths(spark):
    start, trans, emit = registry.HMM
    xs = [[], [1], [2, 1, 0], [0, 0, 2, 1, 2], [1, 1]]
    df = spark.createDataFrame(list(enumerate(xs)), "k int, xs array<int>")
    for r in markov.decoded(df, "k", start, trans, emit).collect():
        x = xs[r.k]
        ways = {p: start[p[0]] * math.prod([trans[a][b] for a, b in itertools.pairwise(p)]) * math.prod([emit[s][o] for s, o in zip(p, x, strict=True)]) for p in itertools.product(range(2), repeat=len(x))} if x else {(): 1.0}
        total = sum(ways.values())
        assert abs(r.loglik - math.log(total)) < 1e-9 and tuple(r.path) == max(ways, key=ways.get)
        for t in range(len(x)):
            for s in range(2):
                assert abs(r.posteriors[t][s] - sum(w for p, w in ways.items() if p[t] == s) / total) < 1e-9
        for a, b in itertools.product(range(2), repeat=2):
            assert abs(r.expected[2 * a + b] - sum(w * sum((u, v) == (a, b) for u, v in itertools.pairwise(p)) for p, w in ways.items()) / total) < 1e-9


PAIRS = [([], []), ([1], []), ([], [2, 1]), ([0, 1, 2], [1, 2]), ([3, 3], [3, 3, 0]), ([2], [2]), ([0, 1, 2, 3], [0, 2, 3])]


def weights(x, y, trans, emit, single):
    out = {}
    for path in every_path(len(x), len(y)):
        p, i, j, prev, n = 1.0, 0, 0, 0, Counter()
        for s in path:
            k = "MID".index(s) + 1
            p *= trans[prev, k] * (emit[x[i], y[j]] if k == 1 else single[y[j]] if k == 2 else single[x[i]])
            n[prev, k] += 1
            i, j, prev = i + (k != 2), j + (k != 3), k
        n[prev, 4] += 1
        out[path] = (p * trans[prev, 4], n)
    return out


def test_pair_model_transitions_and_likeliest(spark):
    """Ragged pairs in one stack: expected transitions, totals, likeliest alignments, and a band that holds everything."""
    trans, emit, single = pairwise.model_arrays(0.3, 0.5, 0.8, 0.2, 4)
    df = spark.createDataFrame([(k, x, y, list(range(len(x)))) for k, (x, y) in enumerate(PAIRS)], "pair_id long, x array<int>, y array<int>, centres array<long>").coalesce(1)
    expected = {}
    for r in pairwise.expected_transitions(df, trans, emit, single).collect():
        expected.setdefault(r.pair_id, {})[r.src, r.dst] = r.n
    best = {r.pair_id: r for r in pairwise.likeliest_alignments(df, trans, emit, single).collect()}
    banded = {r.pair_id: r.loglik for r in pairwise.pair_likelihoods(df, trans, emit, single, band=9).collect()}
    narrow = {r.pair_id: r.loglik for r in pairwise.pair_likelihoods(df, trans, emit, single, band=0).collect()}
    for k, (x, y) in enumerate(PAIRS):
        ways = weights(x, y, trans, emit, single)
        total = sum(p for p, _ in ways.values())
        assert abs(banded[k] - math.log(total)) < 1e-9 and narrow[k] <= banded[k] + 1e-12
        for s, t in itertools.product(range(4), range(1, 5)):
            assert abs(expected[k][s, t] - sum(p * n[s, t] for p, n in ways.values()) / total) < 1e-9
        assert abs(best[k].score - math.log(max(p for p, _ in ways.values()))) < 1e-9 and abs(ways[best[k].states][0] - math.exp(best[k].score)) < 1e-12


def test_sampled_alignments_follow_their_probabilities(spark):
    trans, emit, single = pairwise.model_arrays(0.3, 0.5, 0.8, 0.2, 4)
    x, y = PAIRS[3]
    df = spark.createDataFrame([(k, x, y) for k in range(4000)], "pair_id long, x array<int>, y array<int>")
    drawn = Counter(r.states for r in pairwise.sampled_alignments(df, trans, emit, single, seed=3).collect())
    ways = weights(x, y, trans, emit, single)
    total = sum(p for p, _ in ways.values())
    assert all(abs(drawn[path] / 4000 - p / total) < 0.03 for path, (p, _) in ways.items())


def test_long_ragged_pairs_take_bounded_stacks():
    import pandas as pd

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": [list(rng.integers(0, 4, n)) for n in (512, 3, 200, 0, 511)], "y": [list(rng.integers(0, 4, n)) for n in (480, 512, 1, 0, 500)]})
    seen = []
    for rows, x, y, nx, ny in pairwise.stacks(pdf, 10):
        seen += rows.tolist()
        assert len(rows) == 1 or len(rows) * (x.shape[1] + 1) * (y.shape[1] + 1) * 80 <= pairwise.STACK_BYTES
        assert [len(pdf["x"][r]) for r in rows] == nx.tolist() and [len(pdf["y"][r]) for r in rows] == ny.tolist()
    assert sorted(seen) == list(range(5))


def test_gap_probabilities_against_all_orders():
    trans = pairwise.model_arrays(0.3, 0.5, 0.8, 0.2, 4)[0]
    for kind, (src, dst) in gaps.KINDS.items():
        got = gaps.probabilities(trans, src, dst, 3)
        for i, j in itertools.product(range(4), repeat=2):
            want = 0.0
            for order in set(itertools.permutations("D" * i + "I" * j)):
                states = [src, *(counts.DELETE if s == "D" else counts.INSERT for s in order), dst]
                want += math.prod(trans[a, b] for a, b in itertools.pairwise(states))
            assert abs(got[i, j] - want) < 1e-12, (kind, i, j)


def test_cleaned_columns(spark):
    """Two gaps and unknown residues go without a step, the worked example of an aligned pair."""
    code = {"A": 0, "C": 1, "D": 2, "E": 3, "F": 4, "X": 20, "-": None}
    rows = lambda k, x, y: [(k, p, code[a], code[b]) for p, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows(1, "ACD-E-", "A-DFE-") + rows(2, "AXC", "ACC"), "pair_id long, pos long, a int, b int")
    clean = guards.cleaned(df, 20)
    assert {(r.pair_id, r.pos): r.st for r in clean.collect()} == {(1, 0): 1, (1, 1): 3, (1, 2): 1, (1, 3): 2, (1, 4): 1, (2, 0): 1, (2, 2): 1}
    steps = Counter((r.src, r.dst) for r in counts.transitions(clean.where("pair_id = 1")).collect())
    assert steps == {(0, 1): 1, (1, 3): 1, (3, 1): 1, (1, 2): 1, (2, 1): 1, (1, 4): 1}


def test_lifting_and_lowering(spark):
    n = spark.createDataFrame([("x", 2), ("y", 5)], "k string, n long")
    prior = spark.createDataFrame([("y", 0.5), ("z", 1.5)], "k string, alpha double")
    up = counts.lifted(n, prior, ["k"])
    assert {r.k: r.lifted for r in up.collect()} == {"x": 2.0, "y": 5.5, "z": 1.5}
    assert {r.k: r.n for r in counts.lowered(up, prior, ["k"]).collect()} == {"x": 2.0, "y": 5.0, "z": 0.0}


def tree(spark, rows, *more):
    return spark.createDataFrame(rows, ", ".join([*more, "node string, parent string, length double"]))


def test_strict_cherries_go_up_and_end_at_the_root(spark):
    edges = tree(spark, [("a", "p", 1.0), ("b", "p", 2.0), ("p", "q", 1.0), ("c", "q", 4.0), ("q", "root", 1.0), ("d", "root", 0.5), ("e", "root", 0.25)])
    got = {(r.parent, r.a, r.b): (r.tau, r.of_leaves) for r in cherries.strict_cherries(edges).collect()}
    assert got == {("p", "a", "b"): (3.0, True), ("q", "c", "p"): (5.0, False), ("root", "d", "e"): (0.75, True)}


def test_sibling_cherries_collapse_single_children(spark):
    rows = [("a", "p", 1.0), ("b", "p", 2.0), ("c", "p", 4.0), ("p", "root", 1.0), ("d", "root", 5.5), ("e", "root", 9.0)]
    edges = tree(spark, [(1, *r) for r in rows] + [(2, "x", "r2", 1.0)], "tree int")
    got = [(r.tree, r.a, r.b, r.tau) for r in cherries.sibling_cherries(edges).collect()]
    assert sorted(got) == [(1, "a", "b", 3.0), (1, "c", "d", 10.5)]


def test_pruned_and_rerooted(spark):
    edges = tree(spark, [("a", "p", 1.0), ("b", "p", 2.0), ("p", "q", 1.0), ("c", "q", 4.0), ("q", "root", 1.0), ("d", "root", 0.5), ("f", "g", 1.0), ("g", "root", 2.0)])
    cut = {(r.node, r.parent): r.length for r in trees.pruned(edges, spark.createDataFrame([("b",), ("f",)], "node string")).collect()}
    assert cut == {("a", "q"): 2.0, ("c", "q"): 4.0, ("q", "root"): 1.0, ("d", "root"): 0.5}
    down = {(r.node, r.parent): r.length for r in trees.rerooted(edges, "p").collect()}
    assert down == {("a", "p"): 1.0, ("b", "p"): 2.0, ("q", "p"): 1.0, ("c", "q"): 4.0, ("root", "q"): 1.0, ("d", "root"): 0.5, ("f", "g"): 1.0, ("g", "root"): 2.0}
    assert {r.node: r.height for r in trees.heights(edges).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0, "f": 0, "p": 1, "g": 1, "q": 2, "root": 3}


def test_trees_deeper_than_asked_for_are_refused(spark):
    edges = tree(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    with pytest.raises(ValueError, match="levels"):
        trees.ancestors(edges, 2)
    with pytest.raises(ValueError, match="levels"):
        trees.parsimony(edges, spark.createDataFrame([("a", 1)], "node string, mask int"), 2)
    assert trees.ancestors(edges, 3).count() == 9


def test_score_derivatives_against_differences(spark):
    from pyspark.sql import functions as F

    h = 1e-5
    for lam, mu, t in ((0.03, 0.05, 1.0), (0.4, 0.4, 2.0), (0.2, 0.1, 0.7)):
        row = spark.range(1).select(F.lit(lam).alias("l"), F.lit(mu).alias("m"), F.lit(t).alias("t"))
        made = X.score_derivatives(F.col("l"), F.col("m"), F.col("t"))
        got = row.select(*(x.alias(f"{name}{k}") for name, both in made.items() for k, x in enumerate(both) if not (name == "1-kappa" and lam == mu))).first()

        def values(a, b, t=t):
            g = math.exp((a - b) * t)
            beta = a * (1 - g) / (b - a * g)
            return {"alpha": math.exp(-b * t), "beta": beta, "kappa": a / b}

        for name in ("alpha", "beta"):
            for k, (da, db) in enumerate(((h, 0.0), (0.0, h))):
                # about equal rates, differences are taken across the point, where both sides have distinct rates
                up, down = values(lam + da, mu + db)[name], values(lam - da, mu - db)[name]
                assert abs(got[f"{name}{k}"] - (math.log(up) - math.log(down)) / (2 * h)) < 1e-4
                assert abs(got[f"1-{name}{k}"] - (math.log(1 - up) - math.log(1 - down)) / (2 * h)) < 1e-4


def test_bigrams_of_strings(spark):
    df = spark.createDataFrame([(1, "aab"), (2, ""), (3, "b")], "seq_id int, s string")
    assert {(r.c1, r.c2): r.n for r in counts.bigrams(df, 20).collect()} == {(20, 0): 1, (0, 0): 1, (0, 1): 1, (1, 21): 2, (20, 1): 1}


def test_row_letters_of_frames(spark):
    assert guards.matched_pairs(frame(spark, {1: "MDM", 2: "ID"}), 1).collect()[0].matches == 2


def test_link_mixture_likelihood_never_falls(spark):
    from stemma.operators import mixture

    rng = np.random.default_rng(5)
    names = ", ".join(f"{g} long" for g in mixture.GROUPS)
    rows = [(f, 0.5 + t, *(int(v) for v in rng.integers(1, 40, 8) * (1 + 3 * (f % 2)))) for f in range(30) for t in range(2)]
    parts, trace = mixture.link_mixture_em(spark.createDataFrame(rows, f"fam int, tau double, {names}"), 2, iterations=8, rel_tol=0.0)
    assert len(trace) == 7 and all(b >= a - 1e-6 * abs(a) for a, b in itertools.pairwise(trace))
    assert abs(sum(p["weight"] for p in parts) - 1) < 1e-9 and all(0 < p["lam"] < p["mu"] for p in parts)


def test_aligned_families_hold_every_residue_once_in_order(spark):
    rows = [(1, 10, [0, 1, 2, 3]), (1, 11, [0, 1, 3]), (1, 12, []), (2, 20, [3, 3]), (3, 30, [1]), (3, 31, [1])]
    from stemma.operators import decoding

    got = {}
    model = pairwise.model_arrays(0.02, 0.03, 0.3, 0.2, 4)
    for r in decoding.aligned_families(spark.createDataFrame(rows, "fam long, name long, seq array<int>"), *model).collect():
        got.setdefault((r.fam, r.name), []).append((r.pos, r.col))
    assert got.keys() == {(f, n) for f, n, s in rows if s}
    for f, n, s in rows:
        cols = [c for _, c in sorted(got.get((f, n), []))]
        assert len(cols) == len(s) and cols == sorted(set(cols))
    assert dict(got[1, 11])[2] == dict(got[1, 10])[3] and got[3, 30] == got[3, 31]


def test_stopped_stream_goes_on_from_its_state(spark, tmp_path):
    """A stream that stops after half of its files and runs again ends as one that never stopped."""
    import os
    import time

    from stemma.operators import mixture
    from stemma.streaming import jobs

    rng = np.random.default_rng(7)
    schema = "tau double, " + ", ".join(f"{g} long" for g in mixture.GROUPS)
    files = [spark.createDataFrame([(float(t), *(int(v) for v in rng.integers(1, 30, 8))) for t in (0.5, 1.5)], schema) for _ in range(4)]

    def put(k, folder):
        files[k].coalesce(1).write.parquet(f"{tmp_path}/made-{folder}-{k}")
        (part,) = (f for f in os.listdir(f"{tmp_path}/made-{folder}-{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/{folder}", exist_ok=True)
        os.rename(f"{tmp_path}/made-{folder}-{k}/{part}", f"{tmp_path}/{folder}/{k}.parquet")
        time.sleep(0.05)

    def run(folder):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{folder}")
        return {r.batch: (r.lam, r.mu, r.T) for r in jobs.link_rates(rows, 8, f"{tmp_path}/run-{folder}").collect()}

    for k in range(4):
        put(k, "whole")
    whole = run("whole")
    for k in range(2):
        put(k, "parts")
    assert run("parts").keys() == {0, 1}
    for k in range(2, 4):
        put(k, "parts")
    again = run("parts")
    assert again.keys() == whole.keys() == {0, 1, 2, 3} and all(np.allclose(again[k], whole[k]) for k in whole)


def test_stores(spark, tmp_path):
    from stemma.sources import sequences, stores

    n = spark.createDataFrame([("f", 0, 1, 2), ("f", 0, 2, 0)], "fam string, tau_bin int, a int, n long")
    stores.save_counts(n, f"{tmp_path}/counts", "match")
    assert [tuple(r) for r in stores.load_counts(spark, f"{tmp_path}/counts", "match").collect()] == [("f", 0, 1, 2)]
    for k in range(3):
        stores.save_parameters(spark.createDataFrame([("lam", [0], 0.1 * k)], "name string, idx array<int>, value double"), f"{tmp_path}/parameters", "r", k)
    assert [(r.iter, r.value) for r in stores.load_parameters(spark, f"{tmp_path}/parameters", "r").collect()] == [(2, 0.2)]
    assert stores.load_parameters(spark, f"{tmp_path}/parameters", "r", 1).first().value == 0.1
    keys = [stores.parameters_key(spark.createDataFrame(rows, "name string, idx array<int>, value double")) for rows in ([("a", [0], 1.0), ("b", [1], 2.0)], [("b", [1], 2.0), ("a", [0], 1.0)], [("a", [0], 1.5)])]
    assert keys[0] == keys[1] != keys[2]
    cells = spark.createDataFrame([("f", 1, 2, 0.5), ("g", 0, 0, 0.9)], "fam string, i int, j int, p double")
    stores.save_posteriors(cells, f"{tmp_path}/posteriors", "m", keys[0])
    stores.save_posteriors(cells.where("fam = 'f'").withColumn("p", cells.p / 2), f"{tmp_path}/posteriors", "m", keys[0])
    assert {r.fam: r.p for r in stores.load_posteriors(spark, f"{tmp_path}/posteriors", "m", keys[0]).collect()} == {"f": 0.25, "g": 0.9}
    assert stores.load_posteriors(spark, f"{tmp_path}/posteriors", "m", keys[2]).count() == 0
    assert stores.save_stage(cells, f"{tmp_path}/study", "scores").count() == 2
    import json

    made = json.loads(stores.machine_json([("S", "M", "A", "A", 0.5), ("M", "E", None, None, 1.0)]))
    assert made == {"state": [{"n": 0, "id": "S", "trans": [{"to": 1, "in": "A", "out": "A", "weight": 0.5}]}, {"n": 1, "id": "M", "trans": [{"to": 2, "weight": 1.0}]}, {"n": 2, "id": "E", "trans": []}]}
    pairs = spark.createDataFrame([("AC", "M2", "AC", 0.5, "f", "1", None, None), ("A", "M1", "A", 0.5, "g", "2", None, None)], sequences.PAIR_SCHEMA)
    sequences.write_pairs(pairs, f"{tmp_path}/pairs")
    assert sorted(r.id for r in sequences.read_pair_shards(spark, f"{tmp_path}/pairs").collect()) == ["1", "2"]
    with open(f"{tmp_path}/x.fa", "w") as f:
        f.write(">one a>b\nAC\nGT\n>two\nT\n")
    assert sorted((r.name, r.seq) for r in sequences.read_fasta(spark, f"{tmp_path}/x.fa").collect()) == [("one", "ACGT"), ("two", "T")]
