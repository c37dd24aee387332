"""Tasks stay bounded, and work in proportion, as tables grow."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemma.operators import beam, counts, decoding, pair_times, pairwise, substitution, unaligned
from stemma.sources import tables as T

MODEL = pairwise.model_arrays(0.03, 0.05, 1.0, 0.4, 4)


def drawn(n=30, longest=7, size=4, seed=5):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"pair_id": range(n), "x": [rng.integers(0, size, rng.integers(0, longest)) for _ in range(n)], "y": [rng.integers(0, size, rng.integers(0, longest)) for _ in range(n)]})


def in_spark(spark, pdf):
    return spark.createDataFrame([(int(r.pair_id), r.x.tolist(), r.y.tolist()) for r in pdf.itertuples()], "pair_id long, x array<int>, y array<int>").coalesce(1)


def test_line_items_are_dealt_in_bounded_tasks(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), "id")
    made = T.dealt(rows, "l_orderkey", most=1_000).withColumn("p", F.spark_partition_id())
    sizes = made.groupBy("p").count().collect()
    assert len(sizes) == 60 and max(r["count"] for r in sizes) < 3_000
    assert made.groupBy("l_orderkey").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
    assert T.dealt(rows, "l_orderkey", most=15_000) is rows


@pytest.mark.parametrize("width", [0.5, 3.0, 60.0])
def test_beams_of_a_stack_are_those_of_its_pairs(width):
    pdf = drawn()
    for rows, x, y, nx, ny in pairwise.stacks(pdf):
        total, kept = beam.log_totals(*MODEL, x, y, nx, ny, width)
        for k, r in enumerate(rows):
            assert beam.log_total(*MODEL, pdf["x"][r], pdf["y"][r], width) == (pytest.approx(total[k], abs=1e-12), kept[k])


def test_stacks_of_many_pairs_are_half_full():
    pdf = drawn(3_000, 12)
    made = list(pairwise.stacks(pdf))
    assert sorted(np.concatenate([m[0] for m in made]).tolist()) == list(range(3_000))
    for rows, x, y, nx, ny in made:
        assert len(rows) <= pairwise.FILLED or len(rows) * (x.shape[1] + 1) * (y.shape[1] + 1) <= 2 * ((nx + 1) * (ny + 1)).sum()
        assert all(x[k, : nx[k]].tolist() == pdf["x"][r].tolist() and not x[k, nx[k] :].any() for k, r in enumerate(rows))


def test_tables_by_place_are_those_by_residue():
    """The fit to short pairs no longer handles a table of all pairs of residues for each."""
    model = pair_times.Model(0.03, 0.05, 0.4, *substitution.equal_rates(4))
    for rows, *stack in pairwise.stacks(drawn()):
        t = np.linspace(0.2, 3, len(rows))
        placed = pair_times.Placed(model, *stack)
        total, steps, matches = placed.expectations(t)
        want = pair_times.expectations(model.tables(t, *stack), 4)
        np.testing.assert_allclose(total, want[0], atol=1e-12)
        np.testing.assert_allclose(steps, want[1], atol=1e-12)
        np.testing.assert_allclose(placed.expected_loglik(t, steps, matches), model.expected_loglik(t, want[1], want[2]), atol=1e-10)


def test_accurate_alignments_are_the_decoded_posteriors(spark):
    pairs = in_spark(spark, drawn())
    cells = lambda df: sorted(map(tuple, df.select("pair_id", "i", "j", "p").collect()))
    assert cells(pairwise.accurate_alignments(pairs, *MODEL)) == cells(decoding.optimal_accuracy(pairwise.match_posteriors(pairs, *MODEL, threshold=0.0)))


def test_expected_transitions_leave_a_task_as_one_table(spark):
    pairs = in_spark(spark, drawn(200))
    summed = pairwise.summed_transitions(pairs, *MODEL).collect()
    assert len(summed) <= 16 * 2 and sum(r.pairs for r in summed) == 16 * 200
    each = {(r.src, r.dst): r.n for r in pairwise.expected_transitions(pairs, *MODEL).groupBy("src", "dst").agg(F.sum("n").alias("n")).collect()}
    _, steps, n = unaligned.expected(pairs, (0.03, 0.05, 0.4), 1.0, 4)
    assert n == 200 and all(steps[k] == pytest.approx(v) for k, v in each.items())


def test_letters_are_counted_piece_by_piece(spark):
    """Memory follows the piece, not the batch; texts longer than a piece, empty and null ones count alike."""
    texts = ["abca", None, "", "ZZé", "tt" * 50, "a b\nc", "xyz"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, s string").coalesce(1)
    found = {r.seq_id: r.n for r in counts.letter_vectors(df, 20).collect()}
    want = {k: [float(s.count(chr(97 + c))) for c in range(20)] for k, s in enumerate(texts) if s and any("a" <= x <= "t" for x in s)}
    assert found == want
    pairs = lambda piece: sorted(map(tuple, counts.bigrams(df, 20, piece).collect()))
    assert pairs(3) == pairs(1 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["s"])
    runs = [(lo, len(data)) for _, lo, data, _ in counts._texts([batch], 8)]
    assert len(runs) > 5 and max(n for _, n in runs) == 100 and sum(n for _, n in runs) == sum(len((s or "").encode()) for s in texts)


def test_shares_of_groups(spark):
    df = spark.createDataFrame([("en", [2.0, 0.0, 1.0]), ("en", [0.0, 0.0, 1.0]), (None, [0.0, 5.0, 0.0])], "lang string, n array<double>")
    assert {(r.lang, r.c): r.share for r in counts.letter_shares(df, "lang").collect()} == {("en", 0): 0.5, ("en", 2): 0.5, (None, 1): 1.0}


def test_equal_weights_leave_the_likeliest_class(spark):
    """Two classes that differ in their last bit: adding a prior once made them equal."""
    low = -1.0986122886681102
    df = spark.createDataFrame([(0, 0, low), (0, 1, float(np.nextafter(low, 0)))], "col int, k int, logp double")
    rows = substitution.class_posteriors(df, [0.25] * 4).collect()
    assert {r.likeliest for r in rows} == {1} and all(r.lse == pytest.approx(low + np.log(0.5)) for r in rows)
