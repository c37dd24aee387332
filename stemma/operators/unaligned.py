"""Rates of the fragment model from pairs of sequences whose alignments aren't known.

The E-step sums expected transitions over all alignments of all pairs; of a state's steps to itself, the
share that extends a fragment is known from the model, and the rest are steps of the link model, whose own
statistics and quadratic update follow.  Emissions and the pairs' time are fixed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quadratic_rates
from . import mixture, pairwise
from .counts import DELETE, END, INSERT, MATCH


def link_counts(steps: np.ndarray, trans: np.ndarray, ext: float) -> tuple[dict[str, float], float, float]:
    """(the link model's counts by ``mixture.GROUPS``, extended fragments, ended ones) of expected transitions over S M I D E."""
    link, extended = steps.copy(), 0.0
    for s in (MATCH, INSERT, DELETE):
        more = steps[s, s] * ext / trans[s, s] if trans[s, s] > 0 else 0.0
        extended += more
        link[s, s] -= more
    ended = float(link[[MATCH, INSERT, DELETE]].sum())
    others = [k for k in range(5) if k != DELETE]
    not_insert = [k for k in range(5) if k != INSERT]
    found = {
        "n_alpha": link[:, MATCH].sum(), "n_1malpha": link[:, DELETE].sum(), "n_beta": link[others, INSERT].sum(), "n_1mbeta": link[np.ix_(others, not_insert)].sum(),
        "n_gamma": link[DELETE, INSERT], "n_1mgamma": link[DELETE, not_insert].sum(), "n_kappa": link[:, [MATCH, DELETE]].sum(), "n_1mkappa": link[:, END].sum(),
    }
    return {k: float(v) for k, v in found.items()}, float(extended), ended


def expected(pairs: DataFrame, rates: tuple[float, float, float], t: float, size: int) -> tuple[float, np.ndarray, int]:
    """(log-probability, expected transitions, number) of all pairs (pair_id, x, y): 16 rows reach the driver."""
    made = pairwise.summed_transitions(pairs, *pairwise.model_arrays(rates[0], rates[1], t, rates[2], size))
    steps, total, n = np.zeros((5, 5)), 0.0, 0
    for r in made.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("loglik").alias("loglik"), F.sum("pairs").alias("pairs")).collect():
        steps[r.src, r.dst], total, n = r.n, r.loglik, r.pairs  # each stack of pairs has a row for every step
    return total, steps, n


def statistics(spark, steps: np.ndarray, rates: tuple[float, float, float], t: float, size: int) -> dict[str, float]:
    """The link model's expected statistics, and extended and ended fragments, of expected transitions at some rates."""
    lam, mu, ext = rates
    groups, extended, ended = link_counts(steps, pairwise.model_arrays(lam, mu, t, ext, size)[0], ext)
    row = spark.range(1).select(F.lit(lam).alias("lam"), F.lit(mu).alias("mu"), F.lit(float(t)).alias("tau"), *(F.lit(groups[g]).alias(g) for g in mixture.GROUPS))
    made = mixture.link_statistics(row).first()
    return {**{c: float(made[c]) for c in mixture.STATISTICS}, "extended": extended, "ended": ended}


def maximised(spark, found: dict[str, float]) -> tuple[float, float, float]:
    """The rates that fit those statistics best."""
    new = spark.range(1).select(*quadratic_rates(*(F.lit(found[c]) for c in mixture.STATISTICS))).first()
    return float(new[0]), float(new[1]), found["extended"] / max(found["extended"] + found["ended"], 1e-300)


def fit(pairs: DataFrame, t: float, size: int, *, start: tuple[float, float, float] = (0.03, 0.05, 0.3), iterations: int = 10, rel_tol: float = 1e-7) -> tuple[tuple[float, float, float], list[float]]:
    """((lam, mu, ext), log-probabilities before each iteration): EM over all alignments of all pairs.

    An iteration is one pass; it ends when the log-probability grows by less than ``rel_tol`` of itself.  Without pairs the start is returned.
    """
    spark, rates, trace = pairs.sparkSession, start, []
    for _ in range(iterations):
        total, steps, n = expected(pairs, rates, t, size)
        if not n:
            break
        trace.append(total)
        if len(trace) > 1 and trace[-1] - trace[-2] < rel_tol * abs(trace[-2]):
            break
        rates = maximised(spark, statistics(spark, steps, rates, t, size))
    return rates, trace
