"""Column expressions: distances, times, bins, rate parameters and log-space arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the distance transforms: the greatest time, and the residues of the alphabet.
MAX_TIME, RESIDUES = 5.0, "ACDEFGHIKLMNPQRSTVWY"


def geometric_edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 edges of n bins whose widths grow by one factor."""
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def bin_left_open(x: Column, edges: Sequence[float]) -> Column:
    """The bin (e[i], e[i+1]] that holds x, clamped to the first and last one."""
    below = sum(((x > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(x.isNotNull(), below)


def bin_right_open(x: Column, edges: Sequence[float]) -> Column:
    """The bin [e[i], e[i+1]) that holds x, clamped to the first and last one."""
    below = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(x.isNotNull(), below)


def poisson_time(p: Column) -> Column:
    """Time of a share p of differing residues under equal rates; capped where p nears saturation."""
    return F.when((p >= 0.95) | (1 - p * (20 / 19) <= 0.01), MAX_TIME).otherwise(-F.log(1 - p * (20 / 19)))


def kimura_distance(p: Column, sites: Column) -> Column:
    """-ln(1 - p - p*p/5); infinite below five sites, capped where the logarithm ends."""
    inside = 1 - p - 0.2 * p * p
    return F.when(sites < 5, F.lit(float("inf"))).when(inside <= 0, MAX_TIME).otherwise(-F.log(F.when(inside > 0, inside)))


def jc69_time(d: Column) -> Column:
    inside = 1 - d * (4 / 3)
    return F.when(inside <= 0, MAX_TIME).otherwise(-0.75 * F.log(F.when(inside > 0, inside)))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def birth_death(lam: Column, mu: Column, t: Column) -> dict[str, Column]:
    """alpha, beta, gamma, kappa of a linear birth-death process of links after time t.

    alpha is a link's survival, beta the chance of a further insertion and gamma that of one after a
    deletion; where the rates differ by less than 1e-4 of mu, beta takes its common limit.
    """
    kappa, alpha = lam / mu, F.exp(-mu * t)
    near = F.abs(1 - kappa) < 1e-4
    grown = F.exp((lam - mu) * t)
    beta = F.when(near, mu * t / (1 + mu * t)).otherwise(lam * (1 - grown) / F.when(~near, mu - lam * grown))
    gamma = 1 - beta / (kappa * (1 - alpha))
    return {"alpha": alpha, "beta": beta, "gamma": gamma, "kappa": kappa}


def link_transitions(lam: Column, mu: Column, t: Column, ext: Column | None = None, conditional: bool = False) -> dict[tuple[str, str], Column]:
    """Transitions between S, M, I, D and E of the pair model of single links.

    With ``ext`` a link is a fragment that goes on with that chance; ``conditional`` leaves out the
    ancestor's length distribution.
    """
    p = birth_death(lam, mu, t)
    alpha, kappa = p["alpha"], F.lit(1.0) if conditional else p["kappa"]
    out = {}
    for src in "SMID":
        grow = p["gamma"] if src == "D" else p["beta"]
        row = {"M": (1 - grow) * kappa * alpha, "I": grow, "D": (1 - grow) * kappa * (1 - alpha), "E": (1 - grow) * (F.lit(1.0) if conditional else 1 - p["kappa"])}
        for dst, x in row.items():
            if ext is not None and src != "S":
                x = (1 - ext) * x + ext if src == dst else (1 - ext) * x
            out[src, dst] = x
    return out


def quadratic_rates(births: Column, deaths: Column, links: Column, length: Column, ends: Column, time: Column) -> tuple[Column, Column]:
    """(lambda, mu) at the maximum of the expected log-likelihood of a birth-death process.

    ``links`` is the time that links have lived, ``length`` the expected ancestor's length, ``ends``
    the number of its ends and ``time`` the total time.  kappa = lambda / mu is the smaller root of a
    quadratic; where there is none, each rate is its own ratio.
    """
    a, b = births + length, deaths - length - ends
    second, first, constant = (links + time) * b, -(links * (a + b + 2 * ends) + time * (b + ends)), links * a
    inside = first * first - 4 * second * constant
    solved = (inside >= 0) & (second != 0)
    root = (-first - F.sqrt(F.greatest(inside, F.lit(0.0)))) / (2 * F.when(solved, second))
    kappa = F.greatest(F.least(root, F.lit(1 - 1e-10)), F.lit(1e-10))
    mu = (b + ends / (1 - kappa)) / links
    lam = F.greatest(kappa * mu, F.lit(1e-10))
    plain_lam, plain_mu = F.greatest(births, F.lit(1e-10)) / (links + time), F.greatest(deaths, F.lit(1e-10)) / links
    lam = F.when(solved, lam).otherwise(plain_lam)
    return lam, F.greatest(F.when(solved, mu).otherwise(plain_mu), lam + 1e-10)


def step_size(k: Column, tau: float, kappa: float) -> Column:
    return F.pow(k + tau, F.lit(-kappa))


def discrete_gamma(alpha: float, n: int) -> list[float]:
    """Midpoints of n equal shares of a gamma distribution with mean 1, by the Wilson-Hilferty approximation."""
    from statistics import NormalDist

    raw = [max(1e-8, alpha * (1 - 1 / (9 * alpha) + NormalDist().inv_cdf((i + 0.5) / n) / (3 * math.sqrt(alpha))) ** 3 / alpha) for i in range(n)]
    return [r * n / sum(raw) for r in raw]


#: Fixed by the pair classes: each canonical base pair's number; any other pair has the next one.
BASE_PAIRS = ["AU", "CG", "GC", "UA", "GU", "UG"]


def base_pair_class(left: Column, right: Column) -> Column:
    """0 to 5 for the canonical base pairs, 6 for any other."""
    at = F.array_position(F.array(*map(F.lit, BASE_PAIRS)), F.concat(left, right))
    return F.when(at > 0, at - 1).otherwise(len(BASE_PAIRS)).cast("int")


def softmax(scores: Column) -> Column:
    """An array of log-weights as probabilities."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow: a positive parameter of a free one."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def score_derivatives(lam: Column, mu: Column, t: Column) -> dict[str, tuple[Column, Column]]:
    """The derivatives by lambda and by mu of the logs of alpha, beta, kappa and their complements, by name ("1-" for those).

    Where the rates differ by less than 1e-4 of mu, beta's have their common limit.
    """
    p = birth_death(lam, mu, t)
    alpha, beta, kappa = p["alpha"], p["beta"], p["kappa"]
    near, g = F.abs(1 - kappa) < 1e-4, F.exp((lam - mu) * t)
    below, gone = F.when(~near, mu - lam * g), F.when(~near, 1 - g)
    at, grown = 1 + lam * t, lam * t * t / 2
    by_lam = F.when(near, 1 / lam + t / 2 - (t + grown) / at).otherwise(1 / lam - t * g / gone + (g + lam * t * g) / below)
    by_mu = F.when(near, -t / 2 + grown / at).otherwise(t * g / gone - (1 + lam * t * g) / below)
    none, rest = F.lit(0.0), lambda d: -d * beta / (1 - beta)
    return {
        "alpha": (none, -t), "1-alpha": (none, t * alpha / (1 - alpha)), "beta": (by_lam, by_mu), "1-beta": (rest(by_lam), rest(by_mu)),
        "kappa": (1 / lam, -1 / mu), "1-kappa": (-1 / (mu - lam), lam / (mu * (mu - lam))),
    }


def mixed_fragment_transitions(lam: Column, mu: Column, t: Column, exts: Sequence[float], weights: Sequence[float]) -> dict[tuple[str, str], Column]:
    """Transitions of the link model whose links are fragments of several kinds, by names like M0 and D1.

    A fragment of kind f goes on with chance exts[f]; a new one is of kind g with chance weights[g].
    """
    base, kinds = link_transitions(lam, mu, t), range(len(exts))
    out = {}
    for src in ["S", *(f"{s}{f}" for s in "MID" for f in kinds)]:
        stop = 1 - exts[int(src[1:])] if src != "S" else 1.0
        for dst in "MID":
            for g in kinds:
                go_on = exts[g] if src == f"{dst}{g}" else 0.0
                out[src, f"{dst}{g}"] = stop * weights[g] * base[src[0], dst] + go_on
        out[src, "E"] = stop * base[src[0], "E"]
    return out


def mixed_fragment_lengths(lam: Column, mu: Column, exts: Sequence[float], weights: Sequence[float]) -> dict[tuple[str, str], Column]:
    """Transitions of one sequence of such fragments alone, between S, I0, I1 ... and E."""
    kappa, kinds = lam / mu, range(len(exts))
    out = {}
    for src in ["S", *(f"I{f}" for f in kinds)]:
        stop = 1 - exts[int(src[1:])] if src != "S" else 1.0
        for g in kinds:
            out[src, f"I{g}"] = stop * kappa * weights[g] + (exts[g] if src == f"I{g}" else 0.0)
        out[src, "E"] = stop * (1 - kappa)
    return out
