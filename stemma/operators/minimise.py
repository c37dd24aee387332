"""Minimal grammars: nonterminals that derive every string with the same weight by the same steps become one.

The rules are a table of any size.  A nonterminal's signature is its emissions and its rules with blocks in place of nonterminals,
weights of like ones added up; nonterminals with one signature share a block.  Where no rule leads back to its own left side, blocks are known from the bottom up:
each round names the nonterminals all of whose rules lead to named ones, so rules leave the work as soon as they are settled.  What is left
leads into rings, derives without end and is like nothing named so far; its blocks are refined in rounds until their number no longer grows,
which is the coarsest stable partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored


def _digest(*parts: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def _listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """lhs, sig: all of a nonterminal's (keys, weight) in order, the weights of equal keys added in the order of their size."""
    ordered = rows.groupBy("lhs", *keys).agg(F.aggregate(F.sort_array(F.collect_list("w")), F.lit(0.0), lambda a, x: a + x).alias("w"))
    item = F.concat_ws(",", *(F.col(k).cast("string") for k in keys), F.col("w").cast("string"))
    return ordered.groupBy("lhs").agg(_digest(F.array_join(F.sort_array(F.collect_list(item)), ";")).alias("sig"))


def blocks(rules: DataFrame, emissions: DataFrame, most: int = 10_000) -> DataFrame:
    """lhs, block of every nonterminal of rules (lhs, left, right, w) and emissions (lhs, x, w); a block's name is a digest.

    A nonterminal's rules meet in one row, by digest of each; at most ``most`` rounds from the bottom up, and of refinement.
    """
    names = rules.select("lhs").unionAll(rules.select("left")).unionAll(rules.select("right")).unionAll(emissions.select("lhs")).distinct()
    emitted = _listed(emissions.withColumn("w", F.col("w").cast("double")), ["x"]).withColumnRenamed("sig", "emitted")
    inner = rules.select("lhs", F.lit(True).alias("inner")).distinct()
    known = stored(names.join(emitted, "lhs", "left").join(inner, "lhs", "left").select("lhs", F.coalesce("emitted", F.lit("-")).alias("emitted"), F.col("inner").isNotNull().alias("inner")), "names")
    own = stored(known.where("inner").select("lhs", "emitted"), "emitted")
    new = stored(known.where("not inner").select("lhs", _digest(F.lit("named"), "emitted", F.lit("-")).alias("block")), "blocks")
    nothing = F.lit(None).cast("string")
    rest = stored(rules.select("lhs", "left", "right", F.col("w").cast("double").alias("w"), nothing.alias("left_block"), nothing.alias("right_block")), "rules")
    made = new
    for _ in range(most):
        for name in ("left", "right"):
            at = f"{name}_block"
            found = rest.where(F.col(at).isNull()).drop(at).join(new.select(F.col("lhs").alias(name), F.col("block").alias(at)), name, "left")
            rest = rest.where(F.col(at).isNotNull()).unionByName(found)
        rest = stored(rest, "rules")
        waits = rest.where("left_block is null or right_block is null").select("lhs").distinct()
        sig = _listed(rest.join(waits, "lhs", "left_anti").select("lhs", "left_block", "right_block", "w"), ["left_block", "right_block"])
        new = stored(sig.join(own, "lhs").select("lhs", _digest(F.lit("named"), "emitted", "sig").alias("block")), "blocks")
        if new.isEmpty():
            break
        made, rest = made.unionAll(new), rest.join(waits, "lhs", "left_semi")
    else:
        raise ValueError(f"blocks still grow after {most} rounds")
    return made if rest.isEmpty() else made.unionAll(_refined(rest, own, made, most))


def _refined(rules: DataFrame, own: DataFrame, named: DataFrame, most: int) -> DataFrame:
    """lhs, block of the left sides of ``rules``, by rounds over them all; the others that they lead to are ``named``."""
    left = stored(own.join(rules.select("lhs").distinct(), "lhs", "left_semi").select("lhs", _digest(F.lit("ring"), "emitted").alias("block")), "blocks")
    n, named = left.select("block").distinct().count(), stored(named, "named")
    for _ in range(most):
        made = named.unionAll(left)
        side = lambda name: made.select(F.col("lhs").alias(name), F.col("block").alias(f"{name}_block"))  # noqa: B023, E731
        sig = _listed(rules.select("lhs", "left", "right", "w").join(side("left"), "left").join(side("right"), "right").select("lhs", "left_block", "right_block", "w"), ["left_block", "right_block"])
        new = stored(left.join(sig, "lhs").select("lhs", _digest("block", "sig").alias("block")), "blocks")
        size = new.select("block").distinct().count()
        if size == n:
            return left
        left, n = new, size
    raise ValueError(f"blocks still grow after {most} rounds")


def quotient(rules: DataFrame, emissions: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, emissions) between blocks: those of each block's first nonterminal, weights of like ones added up."""
    first = made.groupBy("block").agg(F.min("lhs").alias("lhs"))
    own = lambda rows: rows.join(first, "lhs").withColumnRenamed("block", "_block").drop("lhs")
    side = lambda name: made.select(F.col("lhs").alias(name), F.col("block").alias(f"{name}_block"))
    small = own(rules).join(side("left"), "left").join(side("right"), "right").groupBy("_block", "left_block", "right_block").agg(F.sum("w").alias("w"))
    return small.toDF("lhs", "left", "right", "w"), own(emissions).groupBy("_block", "x").agg(F.sum("w").alias("w")).toDF("lhs", "x", "w")
