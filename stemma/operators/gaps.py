"""Gap-length probabilities of a pair model: what lies between two matches, or between a match and an end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import DELETE, END, INSERT, MATCH, START

#: Fixed by the tally: each kind of gap and the states around it.
KINDS = {"SM": (START, MATCH), "MM": (MATCH, MATCH), "ME": (MATCH, END), "SE": (START, END)}


def probabilities(trans: np.ndarray, src: int, dst: int, longest: int) -> np.ndarray:
    """By (deletes, inserts) up to ``longest``: the chance of going from ``src`` to ``dst`` with those in between, in any order."""
    size = longest + 1
    ins, dele = np.zeros((size, size)), np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            if j:
                ins[i, j] = trans[src, INSERT] if (i, j) == (0, 1) else ins[i, j - 1] * trans[INSERT, INSERT] + dele[i, j - 1] * trans[DELETE, INSERT]
            if i:
                dele[i, j] = trans[src, DELETE] if (i, j) == (1, 0) else ins[i - 1, j] * trans[INSERT, DELETE] + dele[i - 1, j] * trans[DELETE, DELETE]
    out = ins * trans[INSERT, dst] + dele * trans[DELETE, dst]
    out[0, 0] += trans[src, dst]
    return out


def clipped(trans: np.ndarray, src: int, dst: int, clip: int) -> np.ndarray:
    """By (deletes, inserts) up to ``clip``, the last of either standing for that many or more: the chance of such a gap.

    Lengths up to ``clip`` - 1 have states of their own; the rest is a chain over (deletes, inserts, last state)
    with counts held at ``clip``, whose loops are solved as one linear system.
    """
    size = clip + 1
    number = {(i, j, last): k for k, (i, j, last) in enumerate((i, j, last) for i in range(size) for j in range(size) for last in (INSERT, DELETE))}
    move, begin = np.zeros((len(number), len(number))), np.zeros(len(number))
    into = lambda i, j, to: number[min(i + (to == DELETE), clip), min(j + (to == INSERT), clip), to]
    for to in (INSERT, DELETE):
        begin[into(0, 0, to)] += trans[src, to]
        for (i, j, last), k in number.items():
            move[k, into(i, j, to)] += trans[last, to]
    visits = np.linalg.solve(np.eye(len(number)) - move.T, begin)
    out = np.zeros((size, size))
    for (i, j, last), k in number.items():
        out[i, j] += visits[k] * trans[last, dst]
    out[0, 0] += trans[src, dst]
    return out


def table(spark, trans: np.ndarray, longest: int) -> DataFrame:
    """kind, i, j, logp of every gap of a tally clipped at ``longest``: 4 (longest + 1)^2 rows; the last length is that or more."""
    rows = []
    for kind, (src, dst) in KINDS.items():
        logs = np.log(np.maximum(clipped(trans, src, dst, longest), 1e-30))
        rows += [(kind, i, j, float(logs[i, j])) for i in range(longest + 1) for j in range(longest + 1)]
    return spark.createDataFrame(rows, "kind string, i int, j int, logp double")


def loglik(tally: DataFrame, logs: DataFrame) -> DataFrame:
    """kind, n, loglik of tallied gaps (kind, i, j, n) under a table of their log-probabilities."""
    return tally.join(F.broadcast(logs), ["kind", "i", "j"]).groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("logp")).alias("loglik"))
