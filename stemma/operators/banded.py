"""Pair-model recurrences within a band around given alignments, in band coordinates.

Cell (i, j) of a pair lies in the band where |j - centre of i| <= width.  A row of cells is held by its offset from
the centre, 2 * width + 1 of them, and only the row before is needed for the next one, so memory doesn't depend on the first sequence's length.
Along a row, stays in the insert state are a running log-sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .pairwise import LOG_ZERO

STACK_CELLS = 1 << 18


def _shifted(row: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each pair's row (offsets, pairs) read ``by`` offsets further on; what lies outside is nothing."""
    at = np.arange(len(row))[:, None] + by
    inside = (at >= 0) & (at < len(row))
    return np.where(inside, np.take_along_axis(row, np.clip(at, 0, len(row) - 1), 0), LOG_ZERO)


def log_totals(trans: np.ndarray, emit: np.ndarray, background: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, centre: np.ndarray, width: int) -> np.ndarray:
    """Each pair's log-probability over the alignments whose cells all lie in its band; LOG_ZERO where there is none.

    ``x`` and ``y`` (pairs, longest) are filled up, ``centre`` (pairs, longest x + 1) has the band's middle of every row.
    """
    with np.errstate(divide="ignore"):
        t, e, q = (np.maximum(np.log(v), LOG_ZERO) for v in (trans, emit, background))
    n, offsets = len(x), np.arange(-width, width + 1)[:, None]
    wide = np.concatenate([y, np.zeros((n, 1), y.dtype)], 1)  # so that every offset reads something
    pair, total = np.arange(n), np.where(nx + ny > 0, LOG_ZERO, t[0, 4])
    before, rows = None, [np.full((len(offsets), n), LOG_ZERO) for _ in range(3)]
    for i in range(x.shape[1] + 1):
        middle = centre[:, i]
        j = middle + offsets
        there = (j >= 0) & (j <= ny) & (i <= nx)
        letter = wide[pair, np.clip(j - 1, 0, wide.shape[1] - 1)]
        m = d = np.full(j.shape, LOG_ZERO)
        if i:
            step = middle - before  # (i - 1, j - 1) lies that many offsets, less one, further on in the row before
            diagonal, above = ([_shifted(r, step + k) for r in rows] for k in (-1, 0))
            m = np.logaddexp.reduce([r + t[s + 1, 1] for s, r in enumerate(diagonal)], 0)
            d = np.logaddexp.reduce([r + t[s + 1, 3] for s, r in enumerate(above)], 0)
            if i == 1:
                m, d = np.where(j == 1, np.logaddexp(m, t[0, 1]), m), np.where(j == 0, np.logaddexp(d, t[0, 3]), d)
            one = x[:, i - 1]
            m = np.where(there & (j >= 1), m + e[one, letter], LOG_ZERO)
            d = np.where(there, d + q[one], LOG_ZERO)
        enter = np.full(j.shape, LOG_ZERO)
        enter[1:] = np.logaddexp(m[:-1] + t[1, 2], d[:-1] + t[3, 2])
        if not i:
            enter = np.where(j == 1, np.logaddexp(enter, t[0, 2]), enter)
        stay = np.where(there & (j >= 1), q[letter], 0.0)
        run = np.cumsum(stay + t[2, 2], 0)  # of staying from the first offset on
        ins = run + np.logaddexp.accumulate(np.where(there & (j >= 1), enter + stay - run, LOG_ZERO), 0)
        rows, before = [m, np.where(there & (j >= 1), np.maximum(ins, LOG_ZERO), LOG_ZERO), d], middle
        last = np.flatnonzero((nx == i) & (nx + ny > 0))
        if len(last):
            at = ny[last] - middle[last] + width
            ok = (at >= 0) & (at < len(offsets))
            ends = np.stack([r[np.clip(at, 0, len(offsets) - 1), last] + t[s + 1, 4] for s, r in enumerate(rows)])
            total[last] = np.where(ok, np.logaddexp.reduce(ends, 0), LOG_ZERO)
    return np.maximum(total, LOG_ZERO)


def pair_likelihoods(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, width: int) -> DataFrame:
    """pair_id, loglik of pairs (pair_id, x, y, centres) over the alignments within ``width`` of their centres.

    ``centres`` has for each residue of x how many of y come before its column; the end of both sequences is the last centre.
    """

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            lx, ly = (pdf[c].map(len).to_numpy(np.int64) for c in ("x", "y"))
            order, out = np.lexsort((ly, lx)), np.zeros(len(pdf))
            most = max(1, STACK_CELLS // (2 * width + 1))
            for lo in range(0, len(order), most):
                rows = order[lo : lo + most]
                x, y = (np.zeros((len(rows), int(v[rows].max(initial=0))), np.int64) for v in (lx, ly))
                centre = np.zeros((len(rows), x.shape[1] + 1), np.int64)
                for k, r in enumerate(rows):
                    x[k, : lx[r]], y[k, : ly[r]] = pdf["x"].iloc[r], pdf["y"].iloc[r]
                    given = np.append(np.asarray(pdf["centres"].iloc[r], np.int64), ly[r])[: lx[r] + 1]
                    centre[k, : len(given)], centre[k, len(given) :] = given, given[-1]
                out[rows] = log_totals(trans, emit, background, x, y, lx[rows], ly[rows], centre, width)
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "loglik": out})

    return pairs.select("pair_id", "x", "y", "centres").mapInPandas(run, "pair_id long, loglik double")
