"""Hidden Markov models over symbol sequences, as folds over each sequence's ordered array.

A fold keeps one log-probability per state, so a sequence is read once, inside the JVM.  The models
are small literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_ZERO = -1e30


def log(x: float) -> float:
    return math.log(x) if x > 0 else LOG_ZERO


def gathered(symbols: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and its ordered array of values; an array is as long as its own sequence."""
    return symbols.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("xs"))


def log_sum(terms: Sequence[Column]) -> Column:
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return top + F.log(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))


def _emission(table: Sequence[float], x: Column) -> Column:
    return F.element_at(F.array(*(F.lit(log(p)) for p in table)), x + 1)


def forward(sequences: DataFrame, start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> DataFrame:
    """Adds loglik: the log-probability of each array xs under the model."""
    n = len(start)
    zero = F.struct(*(F.lit(log(p)).alias(f"s{i}") for i, p in enumerate(start)), F.lit(True).alias("first"))

    def step(s: Column, x: Column) -> Column:
        out = []
        for j in range(n):
            into = log_sum([s[f"s{i}"] + log(trans[i][j]) for i in range(n)])
            out.append((F.when(s["first"], s[f"s{j}"]).otherwise(into) + _emission(emit[j], x)).alias(f"s{j}"))
        return F.struct(*out, F.lit(False).alias("first"))

    return sequences.withColumn("loglik", F.aggregate("xs", zero, step, lambda s: F.when(s["first"], 0.0).otherwise(log_sum([s[f"s{i}"] for i in range(n)]))))


def viterbi(sequences: DataFrame, start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> DataFrame:
    """Adds score, the log-probability of the likeliest path; ties don't change it."""
    n = len(start)
    zero = F.struct(*(F.lit(log(p)).alias(f"s{i}") for i, p in enumerate(start)), F.lit(True).alias("first"))

    def step(s: Column, x: Column) -> Column:
        best = [F.greatest(*(s[f"s{i}"] + log(trans[i][j]) for i in range(n))) for j in range(n)]
        return F.struct(*((F.when(s["first"], s[f"s{j}"]).otherwise(best[j]) + _emission(emit[j], x)).alias(f"s{j}") for j in range(n)), F.lit(False).alias("first"))

    return sequences.withColumn("score", F.aggregate("xs", zero, step, lambda s: F.when(s["first"], 0.0).otherwise(F.greatest(*(s[f"s{i}"] for i in range(n))))))


def path_loglik(transition_counts: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """loglik of fixed paths: the sum of n * logp over (src, dst)."""
    return transition_counts.join(table, ["src", "dst"]).groupBy(*by).agg(F.sum(F.col("n") * F.col("logp")).alias("loglik"))


def singlet_loglik(sequences: DataFrame, start: Sequence[float], trans: Sequence[Sequence[float]], end: Sequence[float], emit: Sequence[Sequence[float]]) -> DataFrame:
    """Adds loglik of arrays xs under a model that ends from a state with chance ``end``; an empty one has log(1 - the sum of start)."""
    n = len(start)
    zero = F.struct(*(F.lit(log(p)).alias(f"s{i}") for i, p in enumerate(start)), F.lit(True).alias("first"))

    def step(s: Column, x: Column) -> Column:
        out = []
        for j in range(n):
            into = log_sum([s[f"s{i}"] + log(trans[i][j]) for i in range(n)])
            out.append((F.when(s["first"], s[f"s{j}"]).otherwise(into) + _emission(emit[j], x)).alias(f"s{j}"))
        return F.struct(*out, F.lit(False).alias("first"))

    over = lambda s: F.when(s["first"], log(1 - sum(start))).otherwise(log_sum([s[f"s{i}"] + log(end[i]) for i in range(n)]))
    return sequences.withColumn("loglik", F.aggregate("xs", zero, step, over))


class Chains:
    """Sequences laid out by time: all first symbols, then all second ones, the longest sequences first."""

    def __init__(self, length: np.ndarray):
        self.by = np.argsort(-length, kind="stable")
        longest = int(length.max(initial=0))
        self.open = np.searchsorted(-length[self.by], -np.arange(1, longest + 1), "right")
        self.begin = np.concatenate([[0], np.cumsum(self.open)])
        first = (np.cumsum(length) - length)[self.by]
        self.at = np.concatenate([first[:k] + t for t, k in enumerate(self.open)]) if longest else np.zeros(0, int)

    def steps(self):
        """(symbols at a time, those of the same sequences just before) for every time but the first."""
        for t in range(1, len(self.open)):
            yield slice(self.begin[t], self.begin[t + 1]), slice(self.begin[t - 1], self.begin[t - 1] + self.open[t])

    def last(self, values: np.ndarray) -> np.ndarray:
        """The value at each nonempty sequence's end, in the order of ``by``."""
        out = values[: self.open[0]].copy() if len(self.open) else values[:0]
        for now, _ in self.steps():
            out[: now.stop - now.start] = values[now]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def decode_arrays(x: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loglik of each sequence, state posteriors of each symbol, expected transitions of each sequence, likeliest path).

    ``x`` holds the sequences' symbols one after another.  Of equally good ways into a state the one from the
    lower state is taken, and of equally good ends the lower one.
    """
    with np.errstate(divide="ignore"):
        s, t, e = (np.maximum(np.log(np.asarray(v, float)), LOG_ZERO) for v in (start, trans, emit))
    chains, n = Chains(length), len(s)
    e = e.T[x[chains.at]]
    alpha, best, back = e.copy(), e.copy(), np.zeros(e.shape, np.int64)
    k = int(chains.begin[1]) if len(chains.open) else 0
    alpha[:k] += s
    best[:k] += s
    for now, then in chains.steps():
        alpha[now] += _lse(alpha[then][:, :, None] + t, 1)
        ways = best[then][:, :, None] + t
        back[now] = ways.argmax(1)
        best[now] += ways.max(1)
    total = _lse(chains.last(alpha), 1)
    beta, expected = np.zeros(e.shape), np.zeros((len(length), n, n))
    path = np.zeros(len(x), np.int64)
    state = chains.last(best).argmax(1)
    for now, then in [*chains.steps()][::-1]:
        m = now.stop - now.start
        after = e[now] + beta[now]
        beta[then] = _lse(t + after[:, None], 2)
        expected[chains.by[:m]] += np.exp(alpha[then][:, :, None] + t + after[:, None] - total[:m, None, None])
        path[chains.at[now]] = state[:m]
        state[:m] = back[now][np.arange(m), state[:m]]
    path[chains.at[:k]] = state[:k]
    gamma, loglik = np.zeros((len(x), n)), np.zeros(len(length))
    each = np.concatenate([total[:m] for m in chains.open]) if len(chains.open) else total
    gamma[chains.at] = np.exp(alpha + beta - each[:, None])
    loglik[chains.by[: len(total)]] = total
    return loglik, gamma, expected, path


def decoded(sequences: DataFrame, key: str, start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> DataFrame:
    """key, loglik, posteriors, expected, path of arrays xs: forward-backward and the likeliest states.

    posteriors has an array of state probabilities for each symbol, expected the transition counts row by
    row, path a state for each symbol.  Sequences of a batch are swept together, one step per symbol.
    """

    def run(batches):
        for b in batches:
            xs = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            length = np.array([len(v) if v.is_valid else 0 for v in xs], np.int64)
            loglik, gamma, expected, path = decode_arrays(xs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), length, start, trans, emit)
            n, ends = gamma.shape[1], np.append(0, np.cumsum(length))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(gamma) + 1) * n, pa.int32()), pa.array(gamma.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(loglik), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(length) + 1) * n * n, pa.int32()), pa.array(expected.ravel())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(path.astype(np.int32))),
                ], [key, "loglik", "posteriors", "expected", "path"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, "xs").mapInArrow(run, f"{key} {kind}, loglik double, posteriors array<array<double>>, expected array<double>, path array<int>")


def observation_counts(sequences: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """state, x, n: each symbol counted by its posterior probability of each state."""
    zipped = sequences.join(found.select(key, "posteriors"), key).select(F.explode(F.arrays_zip("xs", "posteriors")).alias("z"))
    return zipped.select(F.col("z.xs").alias("x"), F.posexplode("z.posteriors").alias("state", "p")).groupBy("state", "x").agg(F.sum("p").alias("n"))
