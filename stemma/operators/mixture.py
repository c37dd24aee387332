"""Mixture models over additive statistics: responsibilities, expected counts and EM loops."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import birth_death, quadratic_rates
from ..functions.storage import stored


def soft_responsibilities(scores: DataFrame, key: str) -> DataFrame:
    """Adds weight = softmax of logp over the components of each key, and lse, the key's log-likelihood."""
    w = Window.partitionBy(key)
    top = scores.withColumn("_m", F.max("logp").over(w))
    e = F.exp(F.col("logp") - F.col("_m"))
    return top.withColumn("_s", F.sum(e).over(w)).withColumns({"weight": e / F.col("_s"), "lse": F.col("_m") + F.log("_s")}).drop("_m", "_s")


def hard_responsibilities(scores: DataFrame, key: str, component: str = "k") -> DataFrame:
    """key, component: the best-scoring component, the least one of equals."""
    return scores.groupBy(key).agg(F.min(F.struct((-F.col("logp")).alias("s"), F.col(component).alias("k"))).alias("x")).select(key, F.col("x.k").alias(component))


def gaussian_scores(points: DataFrame, centres: list[list[float]], log_weights: list[float], variance: float) -> DataFrame:
    """vec_id, k, logp of each vector under each of a few spherical components; the centres are literals."""
    out = []
    for k, (c, w) in enumerate(zip(centres, log_weights, strict=True)):
        centre = F.array(*map(F.lit, map(float, c)))
        square = F.aggregate(F.zip_with("embedding", centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        out.append(F.struct(F.lit(k).alias("k"), (F.lit(w) - square / (2 * variance)).alias("logp")))
    return points.select("vec_id", F.explode(F.array(*out)).alias("s")).select("vec_id", "s.k", "s.logp")


def gaussian_em(points: DataFrame, dim: int, k: int, *, variance: float = 1.0, iterations: int = 5) -> tuple[list[list[float]], list[float], list[float]]:
    """(centres, log weights, log-likelihoods) of a spherical mixture by EM.

    An iteration is one pass: each vector weighs itself by its responsibilities in its own row, and the E-step's sums, k * (dim + 2)
    numbers, are all that is exchanged and reaches the driver.  A null component counts as in any sum: not at all.
    """
    first = points.orderBy("vec_id").limit(k).collect()
    centres, logw, trace = [list(map(float, r.embedding)) for r in first], [-math.log(k)] * k, []
    for _ in range(iterations):
        scores = []
        for c, w in zip(centres, logw, strict=True):
            centre = F.array(*map(F.lit, c))
            square = F.aggregate(F.zip_with("embedding", centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
            scores.append(F.lit(w) - square / (2 * variance))
        rows = points.select("embedding", F.array(*scores).alias("s")).withColumn("top", F.array_max("s"))
        rows = rows.withColumn("e", F.transform("s", lambda x: F.exp(x - F.col("top")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        each = rows.select("embedding", (F.col("top") + F.log("total")).alias("lse"), F.posexplode(F.transform("e", lambda x: x / F.col("total"))).alias("k", "w"))
        sums = each.groupBy("k").agg(F.sum("w").alias("n"), F.sum("lse").alias("lse"), F.array(*(F.sum(F.col("w") * F.get("embedding", F.lit(j))) for j in range(dim))).alias("wx")).collect()
        trace.append(next(iter(sums)).lse if sums else 0.0)
        total = sum(s.n for s in sums)
        for s in sums:
            centres[s.k] = [x / max(s.n, 1e-12) for x in s.wx]
            logw[s.k] = math.log(max(s.n, 1e-12) / total)
    return centres, logw, trace


#: The eight sums of a pair's transitions that the link model's log-likelihood is linear in.
GROUPS = ["n_alpha", "n_1malpha", "n_beta", "n_1mbeta", "n_gamma", "n_1mgamma", "n_kappa", "n_1mkappa"]
STATISTICS = ["B", "D", "S", "L", "M", "T"]


def link_statistics(rows: DataFrame) -> DataFrame:
    """Adds the expected births B, deaths D, lived time S, length L, ends M and time T to rows (lam, mu, tau and ``GROUPS``).

    They follow from the scores of the counts' log-likelihood at the rates, and are linear in the counts.  Where the rates
    differ by less than 1e-4 of mu the formulas lose their digits, and at equal rates they divide by nothing; the
    statistics are smooth there, so they are the mean of those at death rates 1e-3 below and above, which are off by its square.
    """
    lam, mu = F.col("lam"), F.col("mu")
    near = F.abs(lam - mu) < 1e-4 * mu
    for side, sign in (("_low", -1), ("_high", 1)):
        rows = _link_statistics(rows.withColumn("_mu", F.when(near, mu * (1 + sign * 1e-3)).otherwise(mu)), side)
    return rows.withColumns({c: (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2 for c in STATISTICS}).drop("_mu", *(f"{c}{side}" for c in STATISTICS for side in ("_low", "_high")))


def _link_statistics(rows: DataFrame, side: str) -> DataFrame:
    """The statistics at unequal rates (lam, _mu), named with ``side``.  Steps are columns of their own, so that no expression is written out again in another."""
    c = F.col
    lam, mu, t = c("lam"), c("_mu"), c("tau")
    names = rows.columns
    rows = rows.withColumn("_e", F.exp((lam - mu) * t)).withColumns({"_den": mu - lam * c("_e"), "_alpha": F.exp(-mu * t)})
    rows = rows.withColumn("_beta", lam * (1 - c("_e")) / c("_den")).withColumn("_g1", mu * c("_beta") / (lam * (1 - c("_alpha"))))
    # derivatives of ln beta by both rates, and of the others from them
    rows = rows.withColumns({"_dbl": 1 / lam - t * c("_e") / (1 - c("_e")) + (c("_e") + lam * t * c("_e")) / c("_den"), "_dbm": t * c("_e") / (1 - c("_e")) - (1 + lam * t * c("_e")) / c("_den")})
    rows = rows.withColumns({"_dgl": -c("_g1") * (c("_dbl") - 1 / lam), "_dgm": -c("_g1") * (1 / mu + c("_dbm") - t * c("_alpha") / (1 - c("_alpha")))})
    both = lambda d_beta, d_gamma: c("n_beta") * c(d_beta) - c("n_1mbeta") * c("_beta") * c(d_beta) / (1 - c("_beta")) + c("n_gamma") * c(d_gamma) / (1 - c("_g1")) - c("n_1mgamma") * c(d_gamma) / c("_g1")
    rows = rows.withColumns({"_by_l": both("_dbl", "_dgl"), "_by_m": both("_dbm", "_dgm") - c("n_alpha") * t + c("n_1malpha") * t * c("_alpha") / (1 - c("_alpha")), "_T": t * c("n_1mkappa")})
    # E[births] - lam * (links + time) = lam * score, E[deaths] - mu * links = mu * score, births - deaths = change in length
    change = c("n_beta") + c("n_gamma") - c("n_1malpha")
    rows = rows.withColumn("_S", (change - lam * c("_by_l") + mu * c("_by_m") - lam * c("_T")) / (lam - mu))
    found = {"B": lam * c("_by_l") + lam * (c("_S") + c("_T")), "D": mu * c("_by_m") + mu * c("_S"), "S": c("_S"), "L": c("n_kappa").cast("double"), "M": c("n_1mkappa").cast("double"), "T": c("_T")}
    return rows.select(*names, *(v.alias(f"{k}{side}") for k, v in found.items()))


def link_loglik(lam: Column, mu: Column, t: Column, n: dict[str, Column]) -> Column:
    """Log-likelihood of counts by ``GROUPS`` under the link model."""
    p = birth_death(lam, mu, t)
    pairs = [("n_alpha", p["alpha"]), ("n_beta", p["beta"]), ("n_gamma", p["gamma"]), ("n_kappa", p["kappa"])]
    return sum((n[name] * F.log(v) + n[name.replace("n_", "n_1m")] * F.log(1 - v) for name, v in pairs), F.lit(0.0))


def birth_death_em(groups: DataFrame, *, iterations: int = 8, start: tuple[float, float] = (0.03, 0.05)) -> DataFrame:
    """iteration, lam, mu of the link model's rates, from rows (tau, n_alpha ... n_1mkappa).

    Every iteration is one aggregate over the rows, and the rates solve its quadratic.
    """
    lam, mu = start
    out = []
    for it in range(iterations):
        made = link_statistics(groups.withColumns({"lam": F.lit(lam), "mu": F.lit(mu)}))
        sums = made.agg(*(F.sum(c).alias(c) for c in STATISTICS))
        new = sums.select(*quadratic_rates(*(F.col(c) for c in STATISTICS))).first()
        lam, mu = new[0], new[1]
        out.append((it, float(lam), float(mu)))
    return groups.sparkSession.createDataFrame(out, "iteration int, lam double, mu double")


def link_mixture_em(groups: DataFrame, k: int, *, iterations: int = 40, rel_tol: float = 1e-6) -> tuple[list[dict], list[float]]:
    """(components with weight, lam and mu; log-likelihoods) of a mixture of link models over families.

    ``groups`` has (fam, tau, n_alpha ... n_1mkappa), a few rows a family.  Families start in components by a
    hash, as softly as three to one, and the log-likelihood isn't known before the first update.  An iteration is
    one pass over families gathered once: each family's likelihood under every component, its responsibilities, and the components' sums, 7
    numbers each.  It ends when the log-likelihood grows by less than ``rel_tol`` of itself.
    """
    bins = stored(groups.groupBy("fam").agg(F.collect_list(F.struct("tau", *GROUPS)).alias("bins")), "family_bins")
    of = lambda b: {g: b[g] for g in GROUPS}

    def score(p: dict) -> Column:
        add = lambda s, b: s + link_loglik(F.lit(p["lam"]), F.lit(p["mu"]), b["tau"], of(b))
        return F.lit(math.log(max(p["weight"], 1e-300))) + F.aggregate("bins", F.lit(0.0), add)

    parts, trace = None, []
    for _ in range(iterations):
        if parts is None:
            at = F.pmod(F.xxhash64("fam"), F.lit(k))
            weights = bins.withColumn("w", F.array(*(F.when(at == j, 3.0).otherwise(1.0) / (k + 2) for j in range(k)))).withColumn("ll", F.lit(0.0))
            rates = [(0.03 + 0.002 * j, 0.05 + 0.002 * j) for j in range(k)]
        else:
            rates = [(p["lam"], p["mu"]) for p in parts]
            weights = bins.withColumn("s", F.array(*map(score, parts))).withColumn("top", F.array_max("s")).withColumn("e", F.transform("s", lambda x: F.exp(x - F.col("top"))))
            whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
            weights = weights.select("bins", F.transform("e", lambda x: x / whole).alias("w"), (F.col("top") + F.log(whole)).alias("ll"))
        # a row for each bin and component
        rate = F.array(*(F.struct(F.lit(lam).alias("lam"), F.lit(mu).alias("mu")) for lam, mu in rates))
        each = weights.select(F.explode("bins").alias("b"), "w").select("b.*", F.posexplode("w").alias("k", "w")).withColumn("r", F.get(rate, "k")).select("*", "r.lam", "r.mu")
        families = weights.agg(*(F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(k)), F.sum("ll").alias("ll")).first()
        sums = link_statistics(each).groupBy("k").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in STATISTICS))
        new = {r.k: r for r in sums.select("k", *(c.alias(n) for n, c in zip(("lam", "mu"), quadratic_rates(*map(F.col, STATISTICS)), strict=True))).collect()}
        total = sum(families[f"w{j}"] for j in range(k))
        if parts is not None:
            trace.append(families["ll"])
        parts = [{"weight": families[f"w{j}"] / total, "lam": new[j].lam, "mu": new[j].mu} for j in range(k)]
        if len(trace) > 1 and trace[-1] - trace[-2] < rel_tol * abs(trace[-2]):
            break
    return parts, trace
