"""Pair-model totals over a beam: of each anti-diagonal only the cells near its best one are kept.

A pair's cells are sparse: those of the two anti-diagonals before are all that the next one needs, so memory and work follow the
beam and not the product of the lengths.  What is cut away is lost, so a total is a lower bound, and with ``width`` infinite the whole one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .pairwise import LOG_ZERO, stacks


def _at(cells: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values (M, I, D) at places ``wanted`` of sorted ``cells``; nothing where there is no cell."""
    if not len(cells):
        return np.full((len(wanted), 3), LOG_ZERO)
    k = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    return np.where((cells[k] == wanted)[:, None], values[k], LOG_ZERO)


def log_total(trans: np.ndarray, emit: np.ndarray, background: np.ndarray, x: np.ndarray, y: np.ndarray, width: float) -> tuple[float, int]:
    """(log-probability over the alignments that stay in the beam, cells kept) of one pair.

    On every anti-diagonal the cells whose forward log-weight is at least the best one's less ``width`` stay.
    """
    with np.errstate(divide="ignore"):
        t, e, q = (np.maximum(np.log(v), LOG_ZERO) for v in (trans, emit, background))
    lx, ly = len(x), len(y)
    if lx + ly == 0:
        return float(t[0, 4]), 1
    none = np.zeros(0, np.int64), np.zeros((0, 3))
    before, last, kept = none, none, 1
    for d in range(1, lx + ly + 1):
        if d == 1:
            i = np.array([0, 1])
        else:  # a gap keeps or raises i from the diagonal before, a match raises it from the one before that
            i = np.union1d(np.union1d(last[0], last[0] + 1), np.union1d(before[0] + 1, [1] if d == 2 else []).astype(np.int64))
        i = i[(i >= max(0, d - ly)) & (i <= min(lx, d))]
        j = d - i
        value = np.full((len(i), 3), LOG_ZERO)
        m, g, h = (i > 0) & (j > 0), j > 0, i > 0
        for s, (ok, cells, step) in enumerate(((m, before, 1), (g, last, 0), (h, last, 1))):
            into = np.logaddexp.reduce(_at(*cells, i[ok] - step) + t[1:4, s + 1], 1)
            begun = np.full(len(into), t[0, s + 1]) if d == (2 if s == 0 else 1) else None
            into = into if begun is None else np.where(i[ok] == step, np.logaddexp(into, begun), into)
            value[ok, s] = into + (e[x[i[ok] - 1], y[j[ok] - 1]] if s == 0 else q[y[j[ok] - 1]] if s == 1 else q[x[i[ok] - 1]])
        value = np.maximum(value, LOG_ZERO)
        best = value.max(1)
        stay = (best >= best.max(initial=LOG_ZERO) - width) & (best > LOG_ZERO / 2) if d < lx + ly else np.ones(len(i), bool)
        before, last = last, (i[stay], value[stay])
        kept += int(stay.sum())
    at = _at(*last, np.array([lx]))[0]
    return max(float(np.logaddexp.reduce(at + t[1:4, 4])), LOG_ZERO), kept


def log_totals(trans: np.ndarray, emit: np.ndarray, background: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """``log_total`` of each pair of a stack (xs, ys, their lengths): an anti-diagonal of all pairs at once, their cells side by side."""
    with np.errstate(divide="ignore"):
        t, e, q = (np.maximum(np.log(v), LOG_ZERO) for v in (trans, emit, background))
    n, wide = len(nx), x.shape[1] + 2  # a cell's place is pair * wide + i
    total, kept = np.full(n, t[0, 4]), np.ones(n, np.int64)
    none = np.zeros(0, np.int64), np.zeros((0, 3))
    before, last, ends = none, none, nx + ny
    for d in range(1, int(ends.max(initial=0)) + 1):
        if d == 1:
            own = np.flatnonzero(ends > 0) * wide
            at = np.concatenate([own, own + 1])
        else:  # as in ``log_total``
            own = np.flatnonzero(ends >= d) * wide if d == 2 else none[0]
            at = np.concatenate([last[0], last[0] + 1, before[0] + 1, own + 1])
        at = np.unique(at)
        k, i = np.divmod(at, wide)
        inside = (ends[k] >= d) & (i >= np.maximum(0, d - ny[k])) & (i <= np.minimum(nx[k], d))
        at, k, i = at[inside], k[inside], i[inside]
        j = d - i
        value = np.full((len(at), 3), LOG_ZERO)
        m, g, h = (i > 0) & (j > 0), j > 0, i > 0
        for s, (ok, cells, step) in enumerate(((m, before, 1), (g, last, 0), (h, last, 1))):
            into = np.logaddexp.reduce(_at(*cells, at[ok] - step) + t[1:4, s + 1], 1)
            if d == (2 if s == 0 else 1):
                into = np.where(i[ok] == step, np.logaddexp(into, t[0, s + 1]), into)
            u, a, b = k[ok], i[ok] - 1, j[ok] - 1
            value[ok, s] = into + (e[x[u, a], y[u, b]] if s == 0 else q[y[u, b]] if s == 1 else q[x[u, a]])
        value = np.maximum(value, LOG_ZERO)
        best, top = value.max(1, initial=LOG_ZERO), np.full(n, LOG_ZERO)
        np.maximum.at(top, k, best)
        ended = ends[k] == d
        stay = ended | ((best >= top[k] - width) & (best > LOG_ZERO / 2))
        before, last = last, (at[stay], value[stay])
        kept += np.bincount(k[stay], minlength=n)
        done = np.flatnonzero(ends == d)
        total[done] = np.maximum(np.logaddexp.reduce(_at(*last, done * wide + nx[done]) + t[1:4, 4], 1), LOG_ZERO)
    return total, kept


def pair_likelihoods(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, width: float) -> DataFrame:
    """pair_id, loglik, cells of pairs (pair_id, x, y): each one's log-probability over its beam, and how many cells that kept.

    Pairs of like lengths are swept together; one whose table alone would fill a stack goes by its own beam.
    """

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for rows, x, y, nx, ny in stacks(pdf, 6):
                if len(rows) > 1:
                    total, kept = log_totals(trans, emit, background, x, y, nx, ny, width)
                else:
                    total, kept = ([v] for v in log_total(trans, emit, background, x[0], y[0], width))
                yield pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy()[rows], "loglik": total, "cells": kept})

    return pairs.select("pair_id", "x", "y").mapInPandas(run, "pair_id long, loglik double, cells long")
