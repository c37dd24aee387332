"""Expectation maximisation of any model that can say what it expects of a batch of rows.

A model is given by a protocol rather than by a class of this library: it turns a batch into a vector of sums
(its log-likelihood first) under some parameters, and sums into parameters.  Batches meet the model where they
lie; a task hands on one vector, and the driver sees only their total.
"""

from __future__ import annotations

from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markov


class Model(Protocol):
    """What ``fit`` asks of a model.  ``columns`` are those of the rows that it reads."""

    columns: list[str]

    def expect(self, parameters: Any, batch: pa.RecordBatch) -> np.ndarray:
        """The log-likelihood of a batch, then its expected statistics, as one vector of a fixed length."""

    def maximise(self, sums: np.ndarray) -> Any:
        """Parameters that fit the statistics of all rows best."""


def totals(rows: DataFrame, model: Model, parameters: Any) -> np.ndarray | None:
    """The sum of what the model expects of all batches; None if there are no rows."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                found = np.asarray(model.expect(parameters, b), float)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    # one vector a task, added up by place: as many rows as the vector is long
    made = rows.select(*model.columns).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r.value for r in made]) if made else None


def fit(rows: DataFrame, model: Model, start: Any, *, iterations: int = 100, rel_tol: float = 1e-6) -> tuple[Any, list[float]]:
    """(parameters, log-likelihoods): iterations go on until the log-likelihood grows by less than ``rel_tol`` of itself.

    Each iteration is one pass over ``rows``, which should be stored if they are dear to make.  The log-likelihoods are those of the
    parameters before each iteration; without rows the start is returned.
    """
    parameters, trace = start, []
    for _ in range(iterations):
        sums = totals(rows, model, parameters)
        if sums is None:
            break
        trace.append(float(sums[0]))
        if len(trace) > 1 and trace[-1] - trace[-2] < rel_tol * abs(trace[-2]):
            break
        parameters = model.maximise(sums)
    return parameters, trace


class HiddenMarkov:
    """A hidden Markov model over arrays xs of symbols: parameters are (start, transitions, emissions).

    ``prior`` is added to every count of the M-step, so that what was never seen keeps a chance.
    """

    columns = ["xs"]

    def __init__(self, states: int, symbols: int, prior: float = 0.0):
        self.states, self.symbols, self.prior = states, symbols, prior

    def expect(self, parameters, batch):
        n = self.states
        xs = batch.column(0)
        length = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = xs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        loglik, gamma, moves, _ = markov.decode_arrays(x, length, *parameters)
        begin = (np.cumsum(length) - length)[length > 0]
        shown = np.zeros((n, self.symbols))
        np.add.at(shown.T, x, gamma)
        return np.concatenate([[loglik.sum()], gamma[begin].sum(0), moves.sum(0).ravel(), shown.ravel()])

    def maximise(self, sums):
        n = self.states
        start, moves, shown = sums[1 : n + 1], sums[n + 1 : n + 1 + n * n].reshape(n, n), sums[n + 1 + n * n :].reshape(n, self.symbols)
        share = lambda v: (v + self.prior) / np.maximum((v + self.prior).sum(-1, keepdims=True), 1e-300)
        return share(start), share(moves), share(shown)
