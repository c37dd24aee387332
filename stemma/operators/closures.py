"""Silent states and empty derivations: closing a model over them, and giving counts of the closed model back.

A chain with silent states T becomes one among the others, T_EE + T_EN (I - T_NN)^-1 T_NE.  A grammar with empty and
single right-hand sides becomes one in binary form: what derives nothing is a least fixed point, single steps are a
matrix that is closed alike.  Expected counts of the closed model then follow for every step of the original one.  Models have a few states,
so all this is NumPy on the driver; counts come from Spark as sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def loops(inner: np.ndarray) -> np.ndarray:
    """The sum of all powers of ``inner``; an error where it doesn't converge."""
    if len(inner) and np.abs(np.linalg.eigvals(inner)).max() >= 1 - 1e-12:
        raise ValueError("a loop of silent steps has a weight of 1 or more")
    return np.linalg.inv(np.eye(len(inner)) - inner)


def closed_chain(trans: np.ndarray, silent: Sequence[int]) -> np.ndarray:
    """Transitions among the states that aren't ``silent``, in their order, over any number of silent ones between."""
    loud = [k for k in range(len(trans)) if k not in set(silent)]
    at = lambda x, y: trans[np.ix_(x, y)]
    return at(loud, loud) + at(loud, silent) @ loops(at(silent, silent)) @ at(silent, loud)


def restored_chain(trans: np.ndarray, silent: Sequence[int], counts: np.ndarray) -> np.ndarray:
    """Expected counts of all transitions, given those of the closed chain."""
    silent = list(silent)
    loud = [k for k in range(len(trans)) if k not in set(silent)]
    at = lambda x, y: trans[np.ix_(x, y)]
    closed, ring = closed_chain(trans, silent), loops(at(silent, silent))
    share = np.divide(counts, closed, out=np.zeros_like(closed), where=counts > 0)
    begin, end = at(loud, silent), at(silent, loud)
    out = np.zeros_like(trans, float)
    out[np.ix_(loud, loud)] = share * at(loud, loud)
    out[np.ix_(loud, silent)] = begin * (share @ (ring @ end).T)
    out[np.ix_(silent, loud)] = ((begin @ ring).T @ share) * end
    out[np.ix_(silent, silent)] = at(silent, silent) * ((begin @ ring).T @ share @ (ring @ end).T)
    return out


def first_order(trans: np.ndarray, emit: np.ndarray, weights: np.ndarray | None = None, start: int = 0, end: int | None = None) -> np.ndarray:
    """Transitions among a start, the symbols and an end, from how symbols stand next to each other in a model's sequences.

    ``trans`` has a start and an end state; states whose row of ``emit`` is empty are silent.  A symbol is followed by
    another as emit^T diag(weights) T_closed emit says, by rows.  All emitting states count alike, or by ``weights``, such as
    ``visits``: then the chain has the model's own frequencies of neighbouring symbols.
    """
    t, begin, inner, last, e = _emitting(trans, emit, start, end)
    w = np.ones(len(inner)) if weights is None else np.asarray(weights, float)
    pairs = e.T @ (w[:, None] * t[np.ix_(inner, inner)]) @ e
    ends = e.T @ (w * t[inner, last])
    total = pairs.sum(1) + ends
    out = np.zeros((e.shape[1] + 2, e.shape[1] + 2))
    out[0, 1:-1], out[0, -1] = t[begin, inner] @ e, t[begin, last]
    seen = np.flatnonzero(total > 0)
    out[seen + 1, 1:-1], out[seen + 1, -1] = pairs[seen] / total[seen, None], ends[seen] / total[seen]
    return out


def visits(trans: np.ndarray, emit: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """How often each emitting state is expected in one sequence of the model."""
    t, begin, inner, _, _ = _emitting(trans, emit, start, end)
    return t[begin, inner] @ loops(t[np.ix_(inner, inner)])


def _emitting(trans: np.ndarray, emit: np.ndarray, start: int, end: int | None) -> tuple[np.ndarray, int, list[int], int, np.ndarray]:
    """The chain closed over its silent states, the places of its start, emitting and end states there, and what these emit."""
    end = len(trans) - 1 if end is None else end
    loud = [k for k in range(len(trans)) if emit[k].sum() > 0]
    silent = [k for k in range(len(trans)) if k not in {*loud, start, end}]
    number = {k: n for n, k in enumerate(k for k in range(len(trans)) if k not in set(silent))}
    return closed_chain(trans, silent), number[start], [number[k] for k in loud], number[end], np.asarray(emit, float)[loud]


def nullable(n: int, rules: Sequence[tuple[int, tuple[int, ...], float]], rounds: int = 100_000) -> np.ndarray:
    """The weight with which each of ``n`` nonterminals derives nothing: the least fixed point over rules (lhs, rhs, weight)."""
    null = np.zeros(n)
    for _ in range(rounds):
        new = np.zeros(n)
        for lhs, rhs, w in rules:
            new[lhs] += w * np.prod([null[c] for c in rhs])
        if new.max(initial=0.0) > 1e100:
            break
        if np.abs(new - null).max(initial=0.0) <= 1e-15 * max(1.0, new.max(initial=0.0)):
            return new
        null = new
    raise ValueError("the weights of empty derivations don't converge")


class Closed:
    """A grammar of rules (lhs, rhs of up to two nonterminals, weight) and emissions, in binary form.

    ``rules`` and ``emissions`` give every nonempty string the weight that the original gives it; ``null`` has the empty one's.
    """

    def __init__(self, n: int, rules: Sequence[tuple[int, tuple[int, ...], float]], emissions: Sequence[tuple[int, int, float]]):
        if any(len(rhs) > 2 for _, rhs, _ in rules):
            raise ValueError("a rule has more than two nonterminals")
        self.n, self.original, self.emitted = n, list(rules), list(emissions)
        self.null = nullable(n, rules)
        #: (from, to, weight, rule, what derives nothing beside it) of every single step
        self.steps = []
        for r, (lhs, rhs, w) in enumerate(self.original):
            if len(rhs) == 1:
                self.steps.append((lhs, rhs[0], w, r, None))
            elif len(rhs) == 2:
                self.steps += [(lhs, here, w * self.null[gone], r, gone) for here, gone in (rhs, rhs[::-1]) if self.null[gone] > 0]
        self.single = np.zeros((n, n))
        for a, b, w, _, _ in self.steps:
            self.single[a, b] += w
        self.ring = loops(self.single)
        pairs = {}
        for lhs, rhs, w in self.original:
            if len(rhs) == 2:
                pairs.setdefault(rhs, np.zeros(n))[lhs] += w
        symbols = {}
        for lhs, x, w in self.emitted:
            symbols.setdefault(x, np.zeros(n))[lhs] += w
        spread = lambda table: [(a, *rest, float(v)) for rest, w in table for a, v in enumerate(self.ring @ w) if v > 0]
        self.rules = spread(pairs.items())
        self.emissions = spread([((x,), w) for x, w in symbols.items()])

    def restored(self, rules: np.ndarray, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of the original's rules and emissions, given those of ``rules`` and ``emissions`` over nonempty strings."""
        of_rules, of_emissions = np.zeros(len(self.original)), np.zeros(len(self.emitted))
        ends = np.zeros((self.n, self.n))  # how often a chain of single steps leads from one nonterminal to another

        def share(closed, counts, originals, out):
            for (a, *rest, w), count in zip(closed, counts, strict=True):
                for r, (lhs, right, weight) in enumerate(originals):
                    if tuple(rest) == right and count:
                        part = count * self.ring[a, lhs] * weight / w
                        out[r] += part
                        ends[a, lhs] += part

        share(self.rules, rules, self.original, of_rules)
        share(self.emissions, emissions, [(lhs, (x,), w) for lhs, x, w in self.emitted], of_emissions)
        # a chain from a to z uses the step p > q as often as ring[a, p] single[p, q] ring[q, z] says of ring[a, z]
        weight = np.divide(ends, self.ring, out=np.zeros_like(ends), where=ends > 0)
        uses = self.ring.T @ weight @ self.ring.T
        gone = np.zeros(self.n)
        for a, b, w, r, beside in self.steps:
            count = uses[a, b] * w
            of_rules[r] += count
            if beside is not None:
                gone[beside] += count
        return of_rules + gone @ self.null_counts(), of_emissions

    def null_counts(self) -> np.ndarray:
        """(nonterminal, rule): how often each rule is expected where a nonterminal derives nothing."""
        own, below = np.zeros((self.n, len(self.original))), np.zeros((self.n, self.n))
        for r, (lhs, rhs, w) in enumerate(self.original):
            if self.null[lhs] > 0:
                p = w * np.prod([self.null[c] for c in rhs]) / self.null[lhs]
                own[lhs, r] = p
                for c in rhs:
                    below[lhs, c] += p
        return np.linalg.solve(np.eye(self.n) - below, own)
