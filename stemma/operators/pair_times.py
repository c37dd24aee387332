"""Times fitted to each pair by its alignment posterior: expected counts at one time, then Newton steps on their log-likelihood.

All pairs of a stack are swept together, each with the tables of its own time.  The expected
log-likelihood of a pair's counts has the slope of its log-probability at the time the counts were taken, so
repeated rounds climb to the likeliest time; one round is the usual estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import families, substitution
from .pairwise import Tables, fragment_transitions, stacks

#: Fixed bounds of a fitted time, and of one Newton step in its logarithm.
LEAST, GREATEST, STEP = 1e-4, 10.0, 1.0


class Model:
    """The fragment model with a reversible substitution model, at any times."""

    def __init__(self, lam: float, mu: float, ext: float, q: np.ndarray, pi: np.ndarray):
        self.rates, self.q, self.pi = (lam, mu, ext), np.asarray(q, float), np.asarray(pi, float)
        self.values, self.left, self.right = substitution.spectrum(self.q, self.pi)

    def transitions(self, t: np.ndarray) -> np.ndarray:
        lam, mu, ext = self.rates
        return fragment_transitions(lam, mu, t, ext)

    def joint(self, t: np.ndarray) -> np.ndarray:
        """Joint probabilities of aligned residues, a table for each time."""
        p = np.maximum((self.left * np.exp(self.values * t[:, None])[:, None]) @ self.right, 0)
        return self.pi[:, None] * p

    def tables(self, t: np.ndarray, *stack) -> Tables:
        return Tables(self.transitions(t), self.joint(t), self.pi, *stack)

    def placed(self, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``joint`` at each pair's own residues, by (pair, place in x, place in y)."""
        p = (self.left[x] * np.exp(self.values * t[:, None])[:, None]) @ self.right.T[y].transpose(0, 2, 1)
        return self.pi[x][..., None] * np.maximum(p, 0)

    def expected_loglik(self, t: np.ndarray, steps: np.ndarray, matches: np.ndarray) -> np.ndarray:
        """Of each pair's expected transitions (5, 5, pairs) and matches (pairs, a, b), at its time."""
        log = lambda p: np.log(np.maximum(p, 1e-300))
        return (steps * log(self.transitions(t))).sum((0, 1)) + (matches * log(self.joint(t))).sum((1, 2))


def expectations(tables: Tables, size: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(log-probability, transitions (5, 5, pairs), matches (pairs, a, b), match posteriors (i, j, pairs)) of a stack; no matches without ``size``."""
    f, total = tables.forward()
    b = tables.backward()
    p = np.exp(f[1:, 1:, 0] + b[1:, 1:, 0] - total)
    p *= (np.arange(tables.lx)[:, None, None] < tables.nx) & (np.arange(tables.ly)[:, None] < tables.ny)
    if size is None:
        return total, tables.transitions(f, b, total), None, p
    cell = (np.arange(tables.n) * size + tables.x.T[:, None]) * size + tables.y.T[None]
    matches = np.bincount(cell.ravel(), p.ravel(), tables.n * size * size).reshape(tables.n, size, size)
    return total, tables.transitions(f, b, total), matches, p


class Placed:
    """A model on a stack of pairs whose tables hold fewer cells than residues have pairs: emissions, and matches, by place instead of by residue."""

    def __init__(self, model: Model, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray):
        self.model, self.stack = model, (x, y, nx, ny)

    def tables(self, t: np.ndarray) -> Tables:
        return Tables(self.model.transitions(t), self.model.placed(t, *self.stack[:2]), self.model.pi, *self.stack, placed=True)

    def expected_loglik(self, t: np.ndarray, steps: np.ndarray, matches: np.ndarray) -> np.ndarray:
        log = lambda p: np.log(np.maximum(p, 1e-300))
        return (steps * log(self.model.transitions(t))).sum((0, 1)) + (matches * log(self.model.placed(t, *self.stack[:2]))).sum((1, 2))

    def expectations(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probability, transitions (5, 5, pairs), match posteriors (pairs, i, j))."""
        total, steps, _, p = expectations(self.tables(t), None)
        return total, steps, p.transpose(2, 0, 1)


def newton(model: Model | Placed, t: np.ndarray, steps: np.ndarray, matches: np.ndarray, iterations: int) -> np.ndarray:
    """Times that climb the expected log-likelihood by Newton steps in the logarithm of the time."""
    z, h = np.log(t), 1e-3
    for _ in range(iterations):
        low, mid, high = (model.expected_loglik(np.exp(z + s * h), steps, matches) for s in (-1, 0, 1))
        slope, bend = (high - low) / (2 * h), (high - 2 * mid + low) / h**2
        move = np.where(bend < -1e-10, -slope / np.minimum(bend, -1e-10), np.sign(slope) * STEP)
        z = np.clip(z + np.clip(move, -STEP, STEP), np.log(LEAST), np.log(GREATEST))
    return np.exp(z)


def _fitted(pdf: pd.DataFrame, model: Model, first: float, rounds: int, iterations: int) -> Iterator[tuple]:
    """(rows, tables, times, log-probabilities, match posteriors) of each stack, at the fitted times."""
    size = len(model.pi)
    for rows, *stack in stacks(pdf, 10):
        t = np.full(len(rows), float(first))
        if stack[0].shape[1] * stack[1].shape[1] <= size * size:
            placed = Placed(model, *stack)
            for _ in range(rounds):
                _, steps, matches = placed.expectations(t)
                t = newton(placed, t, steps, matches, iterations)
            tables = placed.tables(t)
        else:
            for _ in range(rounds):
                _, steps, matches, _ = expectations(model.tables(t, *stack), size)
                t = newton(model, t, steps, matches, iterations)
            tables = model.tables(t, *stack)
        yield rows, tables, t, *expectations(tables, None)[::3]


def pair_times(pairs: DataFrame, model: Model, *, first: float = 1.0, rounds: int = 1, iterations: int = 5) -> DataFrame:
    """pair_id, t, loglik of pairs (pair_id, x, y): each one's fitted time and its log-probability there.

    Two empty sequences say nothing of their time but through the model's end, and take what that gives.
    """

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for rows, _, t, total, _ in _fitted(pdf, model, first, rounds, iterations):
                yield pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy()[rows], "t": t, "loglik": total})

    return pairs.select("pair_id", "x", "y").mapInPandas(run, "pair_id long, t double, loglik double")


def match_posteriors(pairs: DataFrame, model: Model, *, threshold: float = 0.01, first: float = 1.0, rounds: int = 1, iterations: int = 5) -> DataFrame:
    """pair_id, i, j, p, t: match posteriors of at least ``threshold`` at each pair's own fitted time."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for rows, _, t, _, p in _fitted(pdf, model, first, rounds, iterations):
                i, j, k = np.nonzero(p >= threshold)
                yield pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy()[rows][k], "i": i, "j": j, "p": p[i, j, k], "t": t[k]})

    return pairs.select("pair_id", "x", "y").mapInPandas(run, "pair_id long, i int, j int, p double, t double")


def _patterns(model: Model, read, first: float = 1.0, rounds: int = 1, iterations: int = 5) -> families.Patterns:
    """Finds for each pattern what ``read`` makes of its (time, match posteriors) at its fitted time."""

    def solve(pdf: pd.DataFrame) -> list:
        out = [None] * len(pdf)
        for rows, _, t, _, p in _fitted(pdf, model, first, rounds, iterations):
            for k, r in enumerate(rows.tolist()):
                out[r] = read(t[k], p[: len(pdf["x"][r]), : len(pdf["y"][r]), k])
        return out

    return families.Patterns(solve, families.alike(model.pi, model.q))


def member_cells(model: Model, threshold: float = 0.01, **fit) -> families.Patterns:
    """Match posteriors of at least ``threshold`` of each pattern of pairs, as cells."""

    def read(_, p: np.ndarray) -> tuple:
        i, j = np.nonzero(p >= threshold)
        return i, j, p[i, j]

    return _patterns(model, read, **fit)


def member_posteriors(members: DataFrame, model: Model, **fit) -> DataFrame:
    """fam, x, i, y, j, p: match posteriors of every two members of a family (fam, name, seq) at their fitted time."""
    return families.pair_cells(families.blocks(members), lambda: member_cells(model, **fit))


def distances(members: DataFrame, model: Model, **fit) -> DataFrame:
    """fam, x, y, d: the fitted time of each pair x < y of a family's sequences (fam, name, seq).

    All pairs are asked for, so rows grow as the square of a family; they are made in tasks from blocks of members.
    """

    def run(rows):
        solver = _patterns(model, lambda t, _: float(t), **fit)
        for batch in families.batches(rows):
            found, which = solver(batch)
            fam = batch.fam.take(pa.array(batch.row)).cast(pa.int64())
            d = np.array(found, float)[which]
            yield pa.RecordBatch.from_arrays([fam, pa.array(batch.names[batch.x]), pa.array(batch.names[batch.y]), pa.array(d)], names=["fam", "x", "y", "d"])

    return families.tiles(families.blocks(members)).mapInArrow(run, "fam long, x long, y long, d double")
