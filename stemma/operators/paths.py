"""Ordered operators over alignment paths: run lengths, positions, running estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .counts import DELETE, INSERT, MATCH, by_pair

LETTERS = {MATCH: "M", INSERT: "I", DELETE: "D"}


def letter(st: Column) -> Column:
    return F.element_at(F.array(*(F.lit(LETTERS[k]) for k in (MATCH, INSERT, DELETE))), st)


def run_lengths(columns: DataFrame) -> DataFrame:
    """pair_id, rle: each path as M3I1..., from runs of equal states."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("pair_id", "st").orderBy("pos"))
    runs = columns.select("pair_id", "pos", "st", island.alias("island")).groupBy("pair_id", "st", "island").agg(F.min("pos").alias("at"), F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("at", F.concat(letter(F.col("st")), F.col("n").cast("string")).alias("run"))))
    return runs.groupBy("pair_id").agg(F.array_join(parts["run"], "").alias("rle"))


def run_states(rle: Column) -> Column:
    """The states that a run-length string stands for."""
    runs = F.regexp_extract_all(rle, F.lit("([MID][0-9]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda x: F.array_repeat(F.when(x.startswith("M"), MATCH).when(x.startswith("I"), INSERT).otherwise(DELETE), F.substring(x, 2, 9).cast("int"))))


def residue_positions(columns: DataFrame) -> DataFrame:
    """Adds i and j, the residues of either row before and up to each column, counted from 0; -1 before the first."""
    i = F.sum((F.col("st") != INSERT).cast("int")).over(by_pair()) - 1
    j = F.sum((F.col("st") != DELETE).cast("int")).over(by_pair()) - 1
    return columns.withColumns({"i": i, "j": j})


def decayed_weights(rows: DataFrame, key: str, order: list[str], eta: str) -> DataFrame:
    """Adds weight = eta * product of (1 - eta) over all later rows of the key, by a blocked scan from the last row back."""
    made = scans.affine(rows, key, order, 1 - F.col(eta), F.lit(0.0), "weight", start=1.0, backward=True, before=True)
    return made.withColumn("weight", F.col(eta) * F.col("weight"))


def effective_size(rows: DataFrame, key: str) -> DataFrame:
    """ess = (sum of weights)^2 / sum of their squares."""
    return rows.groupBy(key).agg((F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("ess"))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, eta: Column, start: float) -> DataFrame:
    """Adds ema: each row's (1 - eta) * previous + eta * value, from ``start``, by a blocked scan."""
    return scans.affine(rows, key, order, 1 - eta, eta * F.col(value), "ema", start=start)


def early_stop(rows: DataFrame, key: str, order: list[str], value: str, patience: int) -> DataFrame:
    """Adds best (so far), wait (rows since it was set) and stop (wait has reached ``patience``)."""
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(w)
    better = F.coalesce(F.col(value) > F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = rows.withColumn("_set", F.when(better, number)).withColumn("_n", number)
    out = marked.withColumns({"best": F.max(value).over(so_far), "wait": F.col("_n") - F.max("_set").over(so_far)})
    return out.withColumn("stop", F.col("wait") >= patience).drop("_set", "_n")
