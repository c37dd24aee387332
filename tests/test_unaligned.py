"""Rates of the fragment model from unaligned pairs, in passes and from a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import mixture, pairwise, simulate, unaligned
from stemma.streaming import jobs

TRUE = (0.28, 0.3, 0.4)


@pytest.fixture(scope="module")
def pairs(spark):
    ids = spark.range(200).withColumnRenamed("id", "pair_id")
    drawn = simulate.alignments(ids, *pairwise.model_arrays(TRUE[0], TRUE[1], 0.8, TRUE[2], 6), seed=4)
    return pairwise.ungapped(drawn).where("size(x) < 80 and size(y) < 80").cache()


def test_counts_of_a_known_path():
    """Steps of one alignment: without extension they are the link model's own counts."""
    trans = pairwise.model_arrays(*TRUE[:2], 0.8, 0.0, 6)[0]
    steps = np.zeros((5, 5))
    for a, b in zip([0, 1, 3, 2, 1], [1, 3, 2, 1, 4], strict=True):
        steps[a, b] += 1
    found, extended, ended = unaligned.link_counts(steps, trans, 0.0)
    assert extended == 0 and ended == 4
    assert found == {"n_alpha": 2, "n_1malpha": 1, "n_beta": 0, "n_1mbeta": 4, "n_gamma": 1, "n_1mgamma": 0, "n_kappa": 3, "n_1mkappa": 1}
    assert set(found) == set(mixture.GROUPS)


def test_passes_never_lower_the_log_probability(pairs):
    rates, trace = unaligned.fit(pairs, 0.8, 6, start=(0.1, 0.2, 0.2), iterations=12)
    assert (np.diff(trace) >= -1e-6).all() and len(trace) > 3
    assert rates[0] < rates[1] and rates[0] / rates[1] == pytest.approx(TRUE[0] / TRUE[1], abs=0.12) and rates[2] == pytest.approx(TRUE[2], abs=0.15)
    start = (0.1, 0.2, 0.3)
    assert unaligned.fit(pairs.where("pair_id < 0"), 0.8, 6, start=start) == (start, [])


def test_a_stream_of_pairs(spark, pairs, tmp_path):
    pairs.withColumn("part", F.col("pair_id") % 3).repartition(3, "part").drop("part").write.parquet(str(tmp_path / "pairs"))
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pairs"))
    n = pairs.count()
    states = jobs.unaligned_rates(stream, n, str(tmp_path / "run"), 0.8, 6, start=(0.1, 0.2, 0.2)).orderBy("batch").collect()
    assert states[-1].seen == n and all(0 < r.lam < r.mu and 0 < r.ext < 1 for r in states)
    first, last = (unaligned.expected(pairs, (r.lam, r.mu, r.ext), 0.8, 6)[0] for r in (states[0], states[-1]))
    assert last > unaligned.expected(pairs, (0.1, 0.2, 0.2), 0.8, 6)[0] and last > first - 20
