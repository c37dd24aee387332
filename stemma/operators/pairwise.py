"""Two-dimensional recurrences over pairs of sequences, one batch of pairs at a time.

Spark deals the pairs out; within a batch, pairs of like lengths are stacked and all cells of an
anti-diagonal are computed for all of them at once, so the loop in Python is over lengths, not over cells or
pairs, and a stack's tables take a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import DELETE, INSERT

LOG_ZERO = -1e30
STACK_BYTES = 32 << 20  # of tables that a stack of pairs takes
FILLED = 256  # pairs from which on a stack isn't padded to more than twice its cells


def ungapped(columns: DataFrame) -> DataFrame:
    """pair_id, x, y: both rows of each alignment without their gaps, in order."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "st", "a", "b")))
    made = columns.groupBy("pair_id").agg(rows.alias("r"))
    x = F.transform(F.filter("r", lambda c: c["st"] != INSERT), lambda c: c["a"])
    y = F.transform(F.filter("r", lambda c: c["st"] != DELETE), lambda c: c["b"])
    return made.select("pair_id", x.alias("x"), y.alias("y"))


def stacks(pdf: pd.DataFrame, tables: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, xs, ys, lengths of xs, of ys): pairs of like lengths, padded with 0 to the longest of their stack.

    A stack's ``tables`` of 8-byte cells stay within ``STACK_BYTES``, but for a single pair that alone is larger; from ``FILLED`` pairs on
    at most half of them is padding.
    """
    columns = [pdf[c].to_numpy() for c in ("x", "y")]
    lx, ly = (np.fromiter(map(len, c), np.int64, len(c)) for c in columns)
    order, start = np.lexsort((ly, lx)), 0
    sizes = list(zip(lx[order].tolist(), ly[order].tolist(), strict=True))
    while start < len(order):
        end, most_x, most_y, own = start, 0, 0, 0
        while end < len(order):
            a, b = sizes[end]
            most_x, most_y, own = max(most_x, a), max(most_y, b), own + (a + 1) * (b + 1)
            cells = (end + 1 - start) * (most_x + 1) * (most_y + 1)
            if end > start and (cells * 8 * tables > STACK_BYTES or (end - start >= FILLED and cells > 2 * own)):
                break
            end += 1
        rows = order[start:end]
        padded = [np.zeros((len(rows), int(v[rows].max(initial=0))), np.int64) for v in (lx, ly)]
        for table, column, lengths in zip(padded, columns, (lx, ly), strict=True):
            table[np.arange(table.shape[1]) < lengths[rows, None]] = np.concatenate(column[rows])
        yield rows, *padded, lx[rows], ly[rows]
        start = end


def diagonals(lx: int, ly: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells (i, j) of a table, one anti-diagonal after another: none depends on another of its own."""
    for d in range(lx + ly + 1):
        i = np.arange(max(0, d - ly), min(lx, d) + 1)
        yield i, d - i


def global_alignment(pairs: DataFrame, *, match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """pair_id, score, identity, states of the best global alignment; a diagonal step is taken before a gap in x, that before one in y.

    identity is the share of equal columns among all; an empty pair has score 0, identity 0 and no states.
    """

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            score, identity, states = np.zeros(len(pdf)), np.zeros(len(pdf)), [""] * len(pdf)
            for rows, x, y, nx, ny in stacks(pdf, 2):
                n, lx, ly = len(rows), x.shape[1], y.shape[1]
                best, move = np.full((lx + 1, ly + 1, n), LOG_ZERO), np.zeros((lx + 1, ly + 1, n), np.int8)
                best[0, 0] = 0
                for i, j in diagonals(lx, ly):
                    if len(i) == 1 and i[0] == j[0] == 0:
                        continue
                    ways = np.full((3, len(i), n), LOG_ZERO)
                    m, g, h = (i > 0) & (j > 0), j > 0, i > 0
                    ways[0, m] = best[i[m] - 1, j[m] - 1] + np.where(x[:, i[m] - 1] == y[:, j[m] - 1], match, mismatch).T
                    ways[1, g] = best[i[g], j[g] - 1] + gap
                    ways[2, h] = best[i[h] - 1, j[h]] + gap
                    move[i, j], best[i, j] = ways.argmax(0), ways.max(0)
                for k, r in enumerate(rows):
                    i, j, path, same = nx[k], ny[k], [], 0
                    score[r] = best[i, j, k]
                    while i or j:
                        m = move[i, j, k]
                        same += m == 0 and x[k, i - 1] == y[k, j - 1]
                        path.append("MID"[m])
                        i, j = i - (m != 1), j - (m != 2)
                    identity[r], states[r] = same / max(1, len(path)), "".join(reversed(path))
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "score": score, "identity": identity, "states": states})

    return pairs.select("pair_id", "x", "y").mapInPandas(run, "pair_id long, score double, identity double, states string")


class Tables:
    """The pair model's recurrences over a stack of pairs: tables by (i, j, state M I D, pair), all in logs.

    ``trans`` is 5 x 5 over S M I D E, ``emit`` a table of pairs of residues; either may have one for each pair, ``trans``
    along its last and ``emit`` along its first axis.  With ``placed``, ``emit`` is by (pair, place in x, place in y) instead.
    """

    CAME = ((1, 1), (0, 1), (1, 0))

    def __init__(self, trans, emit, background, x, y, nx, ny, placed=False):
        with np.errstate(divide="ignore"):
            t, e, self.q = (np.maximum(np.log(v), LOG_ZERO) for v in (trans, emit, background))
        self.t, self.e = t if t.ndim == 3 else t[..., None], e if e.ndim == 3 else e[None]
        self.x, self.y, self.nx, self.ny, self.n = x, y, nx, ny, len(x)
        self.lx, self.ly = x.shape[1], y.shape[1]
        self.placed = placed
        self.own = np.arange(self.n)[:, None] if len(self.e) > 1 else np.zeros((self.n, 1), int)

    def emitted(self, i: np.ndarray, j: np.ndarray, s: int) -> np.ndarray:
        """Log-emission of the step in state ``s`` that ends in each cell, by (cell, pair)."""
        if s == 0 and self.placed:
            return self.e[:, i - 1, j - 1].T
        return (self.e[self.own, self.x[:, i - 1], self.y[:, j - 1]] if s == 0 else self.q[self.y[:, j - 1]] if s == 1 else self.q[self.x[:, i - 1]]).T

    def forward(self, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(table, total of each pair); with ``best``, of the likeliest alignments instead of all."""
        join = (lambda v: v.max(1)) if best else (lambda v: np.logaddexp.reduce(v, 1))
        f = np.full((self.lx + 1, self.ly + 1, 3, self.n), LOG_ZERO)
        for i, j in diagonals(self.lx, self.ly):
            for s, (di, dj) in enumerate(self.CAME):
                ok = (i >= di) & (j >= dj)
                a, b = i[ok], j[ok]
                if not len(a):
                    continue
                into = join(f[a - di, b - dj] + self.t[1:4, s + 1])
                into[(a == di) & (b == dj)] = self.t[0, s + 1]
                f[a, b, s] = into + self.emitted(a, b, s)
        ends = f[self.nx, self.ny, :, np.arange(self.n)] + self.t[1:4, 4].T
        return f, np.where(self.nx + self.ny > 0, join(ends), self.t[0, 4])

    def backward(self) -> np.ndarray:
        b = np.full((self.lx + 1, self.ly + 1, 3, self.n), LOG_ZERO)
        for i, j in [*diagonals(self.lx, self.ly)][::-1]:
            ways = np.full((len(self.CAME), len(i), 3, self.n), LOG_ZERO)
            for s, (di, dj) in enumerate(self.CAME):
                ok = (i + di <= self.lx) & (j + dj <= self.ly)
                u, v = i[ok] + di, j[ok] + dj
                if len(u):
                    ways[s, ok] = (b[u, v, s] + self.emitted(u, v, s))[:, None] + self.t[1:4, s + 1]
            ended = ((i[:, None] == self.nx) & (j[:, None] == self.ny))[:, None]
            b[i, j] = np.where(ended, self.t[1:4, 4], np.logaddexp.reduce(ways, 0))
        return b

    def transitions(self, f: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Expected numbers of transitions, by (src, dst, pair)."""
        out = np.zeros((5, 5, self.n))
        for i, j in diagonals(self.lx, self.ly):
            for s, (di, dj) in enumerate(self.CAME):
                ok = (i >= di) & (j >= dj)
                a, c = i[ok], j[ok]
                if not len(a):
                    continue
                after = self.emitted(a, c, s) + b[a, c, s] - total
                begun = (a == di) & (c == dj)
                out[0, s + 1] += np.exp(self.t[0, s + 1] + after[begun]).sum(0)
                out[1:4, s + 1] += np.exp(f[a - di, c - dj] + self.t[1:4, s + 1] + after[:, None])[~begun].sum(0)
        ends = np.exp(f[self.nx, self.ny, :, np.arange(self.n)] + self.t[1:4, 4].T - total[:, None]).T
        out[1:4, 4] = np.where(self.nx + self.ny > 0, ends, 0)
        out[0, 4] = self.nx + self.ny == 0
        return out

    def walks(self, f: np.ndarray, choose) -> list[str]:
        """One alignment of every pair, from its end, a step of all pairs at once.

        ``choose`` picks a state for each of some pairs, given their log-weights of M, I and D (pairs, 3), their numbers and that of the step.
        """
        came, rows, step = np.array(self.CAME), np.flatnonzero(self.nx + self.ny > 0), 0
        i, j, to = self.nx.copy(), self.ny.copy(), np.full(self.n, 4)
        path = np.full((self.n, self.lx + self.ly), b"", "S1")
        while len(rows):
            t = self.t[1:4, to[rows], rows if self.t.shape[2] > 1 else 0].T
            s = choose(f[i[rows], j[rows], :, rows] + t, rows, step)
            path[rows, -1 - step] = np.array([b"M", b"I", b"D"])[s]
            i[rows], j[rows], to[rows] = i[rows] - came[s, 0], j[rows] - came[s, 1], s + 1
            rows, step = rows[i[rows] + j[rows] > 0], step + 1
        return [b"".join(p).decode() for p in path.tolist()]


def pair_tables(trans: np.ndarray, emit: np.ndarray, background: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, total) of pairs whose xs, and ys, have one length."""
    n = len(x)
    t = Tables(trans, emit, background, x, y, np.full(n, x.shape[1]), np.full(n, y.shape[1]))
    f, total = t.forward()
    return f, t.backward(), total


def _swept(pairs: DataFrame, model, schema: str, tables: int, made) -> DataFrame:
    """Applies ``made`` (stack's tables, its pair_ids) to every stack of ``pairs`` (pair_id, x, y)."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for rows, x, y, nx, ny in stacks(pdf, tables):
                yield made(Tables(*model, x, y, nx, ny), pdf["pair_id"].to_numpy()[rows])

    return pairs.select("pair_id", "x", "y").mapInPandas(run, schema)


def pair_likelihoods(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, band: int | None = None) -> DataFrame:
    """pair_id, loglik: each pair's log-probability over all alignments, or over those within ``band`` of its ``centres``.

    ``centres`` has for each residue of x how many of y come before its column; the band is around those.
    """
    if band is not None:
        from . import banded

        return banded.pair_likelihoods(pairs, trans, emit, background, band)
    made = lambda t, ids: pd.DataFrame({"pair_id": ids, "loglik": t.forward()[1]})
    return _swept(pairs, (trans, emit, background), "pair_id long, loglik double", 3, made)


def match_posteriors(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, threshold: float = 0.01) -> DataFrame:
    """pair_id, i, j, p: the probability that residues i and j are aligned, where it reaches ``threshold``."""

    def made(t, ids):
        f, total = t.forward()
        p = np.exp(f[1:, 1:, 0] + t.backward()[1:, 1:, 0] - total)
        inside = (np.arange(t.lx)[:, None, None] < t.nx) & (np.arange(t.ly)[:, None] < t.ny)
        i, j, k = np.nonzero((p >= threshold) & inside)
        return pd.DataFrame({"pair_id": ids[k], "i": i, "j": j, "p": p[i, j, k]})

    return _swept(pairs, (trans, emit, background), "pair_id long, i int, j int, p double", 10, made)


def expected_transitions(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray) -> DataFrame:
    """pair_id, loglik, src, dst, n: how often each transition is expected over all alignments of a pair."""

    def made(t, ids):
        f, total = t.forward()
        n = t.transitions(f, t.backward(), total)
        src, dst = np.nonzero(np.ones((5, 5)))
        keep = (src < 4) & (dst > 0)
        rows = np.repeat(np.arange(len(ids)), keep.sum())
        return pd.DataFrame({"pair_id": ids[rows], "loglik": total[rows], "src": np.tile(src[keep], len(ids)), "dst": np.tile(dst[keep], len(ids)), "n": n[src[keep], dst[keep]].T.ravel()})

    return _swept(pairs, (trans, emit, background), "pair_id long, loglik double, src int, dst int, n double", 8, made)


def summed_transitions(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray) -> DataFrame:
    """loglik, pairs, src, dst, n: ``expected_transitions`` of all pairs of a stack together, 16 rows a stack."""

    def made(t, ids):
        f, total = t.forward()
        n = t.transitions(f, t.backward(), total).sum(2)
        src, dst = np.nonzero(np.ones((5, 5)))
        keep = (src < 4) & (dst > 0)
        return pd.DataFrame({"loglik": total.sum(), "pairs": len(ids), "src": src[keep], "dst": dst[keep], "n": n[src[keep], dst[keep]]})

    return _swept(pairs, (trans, emit, background), "loglik double, pairs long, src int, dst int, n double", 8, made)


def accurate_alignments(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray) -> DataFrame:
    """pair_id, i, j, p: the cells of each pair's alignment with the greatest summed match posterior, of all its cells however small.

    These are the cells that ``decoding.optimal_accuracy`` keeps of all ``match_posteriors``, found where the posteriors are made.
    """

    def made(t, ids):
        f, total = t.forward()
        p = np.exp(f[1:, 1:, 0] + t.backward()[1:, 1:, 0] - total)
        inside = (np.arange(t.lx)[:, None, None] < t.nx) & (np.arange(t.ly)[:, None] < t.ny)
        p = np.where(inside, p, -np.inf)
        best = np.zeros((t.lx + 1, t.ly + 1, t.n))
        for k in range(t.lx):
            best[k + 1, 1:] = np.maximum.accumulate(np.maximum(best[k, :-1] + p[k], best[k, 1:]), 0)
        i, j, rows, out = t.nx.copy(), t.ny.copy(), np.flatnonzero((t.nx > 0) & (t.ny > 0)), []
        while len(rows):
            a, b = i[rows], j[rows]
            cell = best[a, b, rows] == best[a - 1, b - 1, rows] + p[a - 1, b - 1, rows]
            up = ~cell & (best[a, b, rows] == best[a - 1, b, rows])
            out.append((rows[cell], a[cell] - 1, b[cell] - 1))
            i[rows], j[rows] = a - (cell | up), b - ~up
            rows = rows[(i[rows] > 0) & (j[rows] > 0)]
        k, i, j = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, int) for c in range(3))
        return pd.DataFrame({"pair_id": ids[k], "i": i, "j": j, "p": p[i, j, k]})

    return _swept(pairs, (trans, emit, background), "pair_id long, i int, j int, p double", 11, made)


def likeliest_alignments(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray) -> DataFrame:
    """pair_id, score, states: the likeliest alignment's log-probability and its states, M before I before D among equals."""

    def made(t, ids):
        f, total = t.forward(best=True)
        return pd.DataFrame({"pair_id": ids, "score": total, "states": t.walks(f, lambda w, *_: w.argmax(1))})

    return _swept(pairs, (trans, emit, background), "pair_id long, score double, states string", 3, made)


def sampled_alignments(pairs: DataFrame, trans: np.ndarray, emit: np.ndarray, background: np.ndarray, seed: int = 0) -> DataFrame:
    """pair_id, states: an alignment drawn with its probability given the pair; the seed and the id fix the draw."""

    def made(t, ids):
        f, _ = t.forward()
        # as many draws as an alignment can have steps, in the order of its steps
        draws = [np.random.default_rng([seed, i & (1 << 64) - 1]).random(k) for i, k in zip(ids.tolist(), (t.nx + t.ny).tolist(), strict=True)]
        table = np.zeros((t.n, t.lx + t.ly))
        table[np.arange(table.shape[1]) < (t.nx + t.ny)[:, None]] = np.concatenate(draws)

        def choose(w, rows, step):
            p = np.exp(w - w.max(1, keepdims=True))
            return (np.cumsum(p, 1) <= (table[rows, step] * p.sum(1))[:, None]).sum(1)

        return pd.DataFrame({"pair_id": ids, "states": t.walks(f, choose)})

    return _swept(pairs, (trans, emit, background), "pair_id long, states string", 3, made)


def fragment_transitions(lam: float, mu: float, t: np.ndarray, ext: float) -> np.ndarray:
    """Transitions of the fragment model over S M I D E at each time of ``t``, along the last axis."""
    t = np.asarray(t, float)
    near = abs(1 - lam / mu) < 1e-4
    alpha, grown, kappa = np.exp(-mu * t), np.exp((lam - mu) * t), lam / mu
    beta = mu * t / (1 + mu * t) if near else lam * (1 - grown) / (mu - lam * grown)
    trans = np.zeros((5, 5, *t.shape))
    for src in range(4):
        g = 1 - beta / (kappa * (1 - alpha)) if src == 3 else beta
        trans[src, 1:] = (1 - g) * kappa * alpha, g, (1 - g) * kappa * (1 - alpha), (1 - g) * (1 - kappa)
        if src:
            trans[src] *= 1 - ext
            trans[src, src] += ext
    return trans


def model_arrays(lam: float, mu: float, t: float, ext: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the fragment model, and joint and single emissions of equal-rate substitution, as arrays."""
    same = np.exp(-t * size / (size - 1))
    emit = (np.full((size, size), (1 - same) / size) + same * np.eye(size)) / size
    return fragment_transitions(lam, mu, t, ext), emit, np.full(size, 1 / size)
