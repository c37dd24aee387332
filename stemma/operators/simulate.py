"""Samplers whose randomness is a hash of the row's key, so that a sample doesn't depend on partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import draw


def uniform(*cols: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from 48 bits of the hash of the seed and the columns."""
    return F.conv(F.substring(draw(*cols, seed=seed), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def choose(u: Column, weights: list[float]) -> Column:
    """The index whose cumulative share u falls into."""
    total, out, below = sum(weights), F.lit(len(weights) - 1), sum(weights)
    for k in range(len(weights) - 1, 0, -1):
        below -= weights[k]
        out = F.when(u < below / total, F.lit(k - 1)).otherwise(out)
    return out


def descendants(ancestors: DataFrame, key: list[str], state: str, p: np.ndarray, seed: int = 0) -> DataFrame:
    """Adds child: a state drawn from row ``state`` of the transition table p, by the hash of the row's key."""
    u = uniform(*key, seed=seed)
    child = choose(u, list(p[-1]))
    for s in range(len(p) - 2, -1, -1):
        child = F.when(F.col(state) == s, choose(u, list(p[s]))).otherwise(child)
    return ancestors.withColumn("child", child)


def transition_shares(steps: DataFrame, states: int) -> DataFrame:
    """src, shares: of the steps (src, dst) from each state the share of each next state, as an array."""
    n = steps.groupBy("src").agg(*(F.count(F.when(F.col("dst") == k, 1)).alias(f"n{k}") for k in range(states)))
    total = sum((F.col(f"n{k}") for k in range(1, states)), F.col("n0"))
    return n.select("src", F.array(*(F.col(f"n{k}") / total for k in range(states))).alias("shares"))


def redrawn(steps: DataFrame, shares: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """``steps`` with drawn: a next state drawn from the shares of its own, by the hash of the row's key."""
    below = F.aggregate("shares", F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), lambda s, x: F.struct((s["at"] + F.when(s["sum"] + x <= F.col("_u"), 1).otherwise(0)).alias("at"), (s["sum"] + x).alias("sum")))
    joined = steps.withColumn("_u", uniform(*key, seed=seed)).join(F.broadcast(shares), "src")  # a row for each state
    return joined.withColumn("drawn", F.least(below["at"], F.size("shares") - 1)).drop("_u", "shares")


def alignments(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, *, seed: int = 0) -> DataFrame:
    """pair_id, pos, st, a, b: one alignment drawn from the pair model for each pair, from a generator seeded by the pair.

    ``trans`` has the states S M I D E; every state must be able to reach the end.  All alignments of a batch advance
    together, one column a step, until the longest has ended.
    """
    reach = np.linalg.matrix_power((trans > 0) | np.eye(5, dtype=bool), 5)
    if not reach[:4, 4].all():
        raise ValueError("a state can't reach the end")
    steps, cells = np.cumsum(trans, 1), np.cumsum(emit.ravel())
    single = np.cumsum(background)

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            rngs = [np.random.default_rng([seed, int(k)]) for k in keys]
            open_, state, pos, out = np.arange(len(keys)), np.zeros(len(keys), np.int64), 0, []
            while len(open_):
                u = np.array([rngs[k].random(2) for k in open_])
                state = (u[:, :1] * steps[state, -1:] >= steps[state]).sum(1)
                go = state != 4
                open_, state, u = open_[go], state[go], u[go, 1]
                cell = np.minimum((u[:, None] * cells[-1] >= cells).sum(1), emit.size - 1)
                one = np.minimum((u[:, None] * single[-1] >= single).sum(1), len(background) - 1)
                a, c = np.where(state == 1, cell // emit.shape[1], one), np.where(state == 1, cell % emit.shape[1], one)
                out.append((keys[open_], np.full(len(open_), pos), state, a, c))
                pos += 1
            made = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            key, at, st, a, c = made
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(st.astype(np.int32)), pa.array(a.astype(np.int32), mask=st == 2), pa.array(c.astype(np.int32), mask=st == 3)], ["pair_id", "pos", "st", "a", "b"])

    return pairs.select(F.col("pair_id").cast("long")).mapInArrow(run, "pair_id long, pos long, st int, a int, b int")
