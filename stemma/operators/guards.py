"""Guards and filters over aligned rows, pairs and families, all of them column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counts import DELETE, INSERT, MATCH, classify


def cleaned(rows: DataFrame, size: int) -> DataFrame:
    """pair_id, pos, st, a, b of aligned rows (pair_id, pos, a, b), null for a gap.

    Columns with two gaps go, and so do those with a residue outside 0 .. size - 1: they take no step
    and leave the state before them as it was.
    """
    st = classify(F.col("a").isNull(), F.col("b").isNull())
    known = lambda c: F.col(c).isNull() | F.col(c).between(0, size - 1)
    return rows.withColumn("st", st).where(F.col("st").isNotNull() & known("a") & known("b")).select("pair_id", "pos", "st", "a", "b")


def validated(records: DataFrame, cap: int) -> DataFrame:
    """Adds n_cols, ok and message to records (rle, x, y): run lengths must fit both sequences and the cap.

    x and y are strings of capital letters; the first rule that fails gives the message.
    """
    runs = F.regexp_extract_all("rle", F.lit("([MID][0-9]+)"), F.lit(1))
    total = lambda kinds: F.aggregate(F.filter(runs, lambda r: F.substring(r, 1, 1).isin(kinds)), F.lit(0).cast("long"), lambda s, r: s + F.substring(r, 2, 18).cast("long"))
    named = records.withColumns({"n_cols": total(["M", "I", "D"]), "_x": total(["M", "D"]), "_y": total(["M", "I"])})
    message = (
        F.when(F.col("rle").isNull() | ~F.col("rle").rlike("^([MID][0-9]+)+$"), "bad run lengths").when(F.col("x").isNull() | ~F.col("x").rlike("^[A-Y]*$"), "bad letters in x").when(F.col("y").isNull() | ~F.col("y").rlike("^[A-Y]*$"), "bad letters in y")
        .when(F.col("_x") != F.length("x"), "x has another length").when(F.col("_y") != F.length("y"), "y has another length").when(F.col("n_cols") > cap, "too long")
    )
    return named.withColumn("message", F.coalesce(message, F.lit("ok"))).withColumn("ok", F.col("message") == "ok").drop("_x", "_y")


def eligible_families(pairs: DataFrame, sizes: DataFrame, members: tuple[int, int], least_cols: int) -> DataFrame:
    """fam, members, cols of the families with a number of members in range and a longest pair of enough columns; ``sizes`` is (pair_id, n_cols)."""
    made = pairs.join(sizes, "pair_id").groupBy("fam").agg(F.count("*").alias("members"), F.max("n_cols").alias("cols"))
    return made.where(F.col("members").between(*members) & (F.col("cols") >= least_cols))


def families_with_empty_columns(rows: DataFrame) -> DataFrame:
    """fam, empty: how many columns of aligned residues (fam, col, res) hold gaps only, for families that have any."""
    columns = rows.groupBy("fam", "col").agg(F.every(F.col("res").isNull()).alias("empty"))
    return columns.groupBy("fam").agg(F.sum(F.col("empty").cast("long")).alias("empty")).where("empty > 0")


def column_labels(rows: DataFrame) -> DataFrame:
    """fam, col, observed, label: each column's commonest residue (the least of equals), -1 where too few rows have one.

    Enough is at least three rows and a quarter of the family's greatest number of rows in a column.
    """
    n = rows.groupBy("fam", "col", "res").agg(F.count("*").alias("n"))
    full = F.col("res").isNotNull()
    best = F.min(F.when(full, F.struct(-F.col("n"), "res")))
    columns = n.groupBy("fam", "col").agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("observed"), F.sum("n").alias("rows"), best.alias("best"))
    most = F.max("rows").over(Window.partitionBy("fam"))
    few = F.col("observed") < F.greatest(F.lit(3), F.floor(most / 4))
    return columns.select("fam", "col", "observed", F.when(few | F.col("best").isNull(), -1).otherwise(F.col("best.res")).alias("label"))


def insane_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The cells whose count is null, not a number or negative; a sound table gives none."""
    n = F.col("n")
    return counts.where(n.isNull() | F.isnan(n.cast("double")) | (n < 0)).select(*keys, "n")


def band_centres(columns: DataFrame) -> DataFrame:
    """pair_id, i, centre: for each residue of the first row, how many of the second row come before its column."""
    before = Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    i = F.coalesce(F.sum((F.col("st") != INSERT).cast("long")).over(before), F.lit(0))
    centre = F.coalesce(F.sum((F.col("st") != DELETE).cast("long")).over(before), F.lit(0))
    return columns.select("pair_id", "st", i.alias("i"), centre.alias("centre")).where(F.col("st") != INSERT).drop("st")


def matched_pairs(columns: DataFrame, least: int) -> DataFrame:
    """pair_id, matches of the pairs with at least ``least`` match columns."""
    return columns.groupBy("pair_id").agg(F.sum((F.col("st") == MATCH).cast("long")).alias("matches")).where(F.col("matches") >= least)
