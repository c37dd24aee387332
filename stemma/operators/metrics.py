"""Scores of alignments and predictions: sum of pairs, total columns, F1, rank correlation, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_of_pairs(reference: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """sp of each group: the share of the reference's residue pairs (by, i, j) that the test has too."""
    hit = test.select(*by, "i", "j").distinct().withColumn("hit", F.lit(1))
    joined = reference.select(*by, "i", "j").distinct().join(hit, [*by, "i", "j"], "left")
    return joined.groupBy(*by).agg(F.count("*").alias("gold"), F.count("hit").alias("tp")).withColumn("sp", F.col("tp") / F.col("gold"))


def column_signatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, sig of each column (by, col, name, pos): its residues' names and positions in order."""
    return rows.where("pos is not null").groupBy(*by, "col").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", F.col("pos").cast("string")))), ",").alias("sig")).select(*by, "sig").distinct()


def total_columns(reference: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """tc of each group: the share of the reference's columns that the test has in full."""
    hit = column_signatures(test, by).withColumn("hit", F.lit(1))
    return column_signatures(reference, by).join(hit, [*by, "sig"], "left").groupBy(*by).agg((F.count("hit") / F.count("*")).alias("tc"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def confusion(rows: DataFrame, truth: str, said: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of 0/1 columns."""
    n = lambda t, s: F.sum(((F.col(truth) == t) & (F.col(said) == s)).cast("int"))
    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "f1": f1(F.col("tp"), F.col("fp"), F.col("fn"))})


def expected_f1(truth: DataFrame, posterior: DataFrame, by: list[str]) -> DataFrame:
    """e_tp, mass, gold and their F1: posterior mass on the true cells (by, i, j); truth outside the posterior still counts."""
    hits = truth.join(posterior, [*by, "i", "j"], "left").groupBy(*by).agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("e_tp"), F.count("*").alias("gold"))
    mass = posterior.groupBy(*by).agg(F.sum("p").alias("mass"))
    return hits.join(mass, by, "left").withColumn("mass", F.coalesce("mass", F.lit(0.0))).withColumn("f1", 2 * F.col("e_tp") / (F.col("mass") + F.col("gold")))


def average_ranks(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs."""
    w = Window.partitionBy(group)
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2)


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """rho of each group: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(rows, group, x, "_rx"), group, y, "_ry")
    return ranked.groupBy(group).agg(F.corr("_rx", "_ry").alias("rho"))


def rolled_up(rows: DataFrame, levels: list[str], sums: list[str]) -> DataFrame:
    """Sums at every level of a hierarchy, the whole included; null stands for all."""
    return rows.rollup(*levels).agg(*(F.sum(c).alias(c) for c in sums))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, least, greatest and the 10, 25, 50, 75 and 90 per cent points, interpolated."""
    q = F.percentile(value, F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    made = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), q.alias("q"))
    return made.select(*by, "n", "mean", "least", "greatest", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))))


def information_criteria(models: DataFrame, n: int | Column) -> DataFrame:
    """Adds aic and bic to (model, loglik, k) of ``n`` observations."""
    size = n.cast("double") if isinstance(n, Column) else F.lit(float(n))
    return models.withColumns({"aic": 2 * F.col("k") - 2 * F.col("loglik"), "bic": F.col("k") * F.log(size) - 2 * F.col("loglik")})


def means(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, total, mean and the mean's standard error."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def histogram(rows: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` commonest values and their counts, equal counts by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def accuracy(groups: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """accuracy of each group: the share of rows whose truth and said agree, 0 where there are none."""
    right = rows.groupBy(*by).agg(F.avg((F.col("truth") == F.col("said")).cast("double")).alias("accuracy"))
    return groups.join(right, by, "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))


def log_posteriors(rows: DataFrame, by: list[str], cut: float = 0.5, floor: float = 1e-30) -> DataFrame:
    """of_prediction, of_truth: the log-probability of (p >= cut) and of the truth under p.

    Probabilities are floored, but a truth that has probability 0 outright makes its sum minus infinity.
    """
    p, ln = F.col("p"), lambda x: F.log(F.greatest(x, F.lit(floor)))
    none = F.lit(float("-inf"))
    said = F.when(p >= cut, ln(p)).otherwise(ln(1 - p))
    true = F.when(F.col("truth"), F.when(p == 0, none).otherwise(ln(p))).otherwise(F.when(p == 1, none).otherwise(ln(1 - p)))
    return rows.groupBy(*by).agg(F.sum(said).alias("of_prediction"), F.sum(true).alias("of_truth"))


def core_scores(reference: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """pairs, sp, tc over the core residues of a reference (by, col, name, pos, core) for groups with a core column.

    A core column has core residues of two rows or more; sp is the share of their pairs that the test aligns
    too, tc the share of core columns whose core residues all share one column of the test.
    """
    core = reference.where("core and pos is not null").select(*by, "col", "name", "pos")
    placed = core.join(test.where("pos is not null").select(*by, "name", "pos", F.col("col").alias("there")), [*by, "name", "pos"], "left")
    by_place = placed.groupBy(*by, "col", "there").agg(F.count("*").alias("n"))
    twos = lambda n: n * (n - 1) / 2
    found = F.sum(F.when(F.col("there").isNotNull(), twos(F.col("n"))).otherwise(0))
    columns = by_place.groupBy(*by, "col").agg(F.sum("n").alias("n"), found.alias("hit"), (F.count_distinct("there") == 1).alias("one"), F.every(F.col("there").isNotNull()).alias("all")).where("n > 1")
    out = columns.groupBy(*by).agg(F.sum(twos(F.col("n"))).cast("long").alias("pairs"), F.sum("hit").alias("hit"), F.avg((F.col("one") & F.col("all")).cast("double")).alias("tc"))
    return out.select(*by, "pairs", (F.col("hit") / F.col("pairs")).alias("sp"), "tc")


def posterior_mass(cells: DataFrame, posterior: DataFrame, by: list[str]) -> DataFrame:
    """score, aligned: posterior mass and number of an alignment's residue pairs (by, i, j); absent cells count 0."""
    joined = cells.join(posterior, [*by, "i", "j"], "left")
    return joined.groupBy(*by).agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("score"), F.count("*").alias("aligned"))


def grouped_by_sets(rows: DataFrame, sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Sums by each of several sets of keys in one pass; null stands for all."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*(F.sum(c).alias(c) for c in sums)).select(*keys, *sums)
