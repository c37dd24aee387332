"""Joins, set operations, splits and samples over families and pairs.

Random choices are the order of a hash of the id and a seed, so a sample is the same on every run
and however the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*cols: str | Column, seed: int = 0) -> Column:
    """A hash order: the MD5 of the seed and the columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def lookup_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (fam, name_a, name_b, ...) with both names' rows as aln_a and aln_b."""
    left = rows.select("fam", F.col("name").alias("name_a"), F.col("aln").alias("aln_a"))
    right = rows.select("fam", F.col("name").alias("name_b"), F.col("aln").alias("aln_b"))
    return pairs.join(left, ["fam", "name_a"]).join(right, ["fam", "name_b"])


def guarded_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose rows have one length and whose tau is positive and finite."""
    return pairs.where((F.length("aln_a") == F.length("aln_b")) & (F.col("tau") > 0) & ~F.isnan("tau") & (F.col("tau") < float("inf")))


def missing_partners(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(fam, name) that pairs ask for and no row has."""
    asked = pairs.select("fam", F.col("name_a").alias("name")).unionAll(pairs.select("fam", F.col("name_b").alias("name"))).distinct()
    return asked.join(rows.select("fam", "name").distinct(), ["fam", "name"], "left_anti")


def all_pairs(members: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key_a, key_b) of each unordered pair within a group: an equality join on the group and a range on the key."""
    left = members.select(group, F.col(key).alias(f"{key}_a"))
    right = members.select(group, F.col(key).alias(f"{key}_b"))
    return left.join(right, group).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def with_clan(families: DataFrame, clans: DataFrame) -> DataFrame:
    """Adds clan: the family's own name where it has none."""
    return families.join(clans, "fam", "left").withColumn("clan", F.coalesce("clan", F.col("fam").cast("string")))


def unseen(rows: DataFrame, seen: DataFrame, content: str) -> DataFrame:
    """Rows whose content hash isn't in ``seen`` (h)."""
    return rows.withColumn("h", content_hash(F.col(content))).join(seen.select("h").distinct(), "h", "left_anti")


def without_copies(rows: DataFrame, content: str, key: str) -> DataFrame:
    """h and the least key of each content."""
    return rows.groupBy(content_hash(F.coalesce(F.col(content), F.lit(""))).alias("h")).agg(F.min(key).alias(key))


def cumulative_split(groups: DataFrame, key: str, size: str, bounds: Sequence[float], names: Sequence[str], seed: int = 0) -> DataFrame:
    """Adds split: groups in hash order, each by the share of rows that come before it.

    Before the running sum, sizes are summed by hash range, so no task sorts more than one range and
    the ranges' offsets are a table of fixed size.
    """
    h = draw(key, seed=seed)
    rows = groups.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 2))
    totals = rows.groupBy("_range").agg(F.sum(size).alias("_n"))  # at most 256 rows
    offset = totals.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    placed = rows.join(F.broadcast(offset.drop("_n")), "_range")
    before = F.sum(size).over(Window.partitionBy("_range").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size) + F.col("_before")
    share = before / F.col("_all")
    split = F.lit(names[-1])
    for bound, name in list(zip(bounds, names, strict=False))[::-1]:
        split = F.when(share < bound, name).otherwise(split)
    return placed.withColumn("split", split).drop("_h", "_range", "_before", "_all")


def first_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """At most ``n`` rows of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: the least in hash order."""
    return rows.orderBy(draw(key, seed=seed), key).limit(n)


def least_visited(rows: DataFrame, visits: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with the fewest visits, ties in hash order."""
    return rows.orderBy(visits, draw(key, seed=seed), key).limit(n)


def random_pairs(members: DataFrame, group: str, key: str, c: float, seed: int = 0) -> DataFrame:
    """An Erdos-Renyi sample of each group's pairs with chance min(1, c ln N / N), all of them up to three members.

    The hash's first 32 bits decide; members without a pair get one with the group's least other member.
    """
    size = members.groupBy(group).agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    both = all_pairs(members, group, key).join(size, group)
    chance = F.when(F.col("_n") <= 3, 1.0).otherwise(F.least(F.lit(1.0), F.lit(c) * F.log("_n") / F.col("_n")))
    u = F.conv(F.substring(draw(f"{key}_a", f"{key}_b", seed=seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    a, b = f"{key}_a", f"{key}_b"
    chosen = both.where(u < chance).select(group, a, b)
    inside = chosen.select(group, F.explode(F.array(a, b)).alias(key)).distinct()
    alone = members.join(inside, [group, key], "left_anti").join(size, group).where((F.col("_n") > 1) & (F.col(key) != F.col("_first")))
    return chosen.unionAll(alone.select(group, F.col("_first").alias(a), F.col(key).alias(b)))


def held_out_leaf(distances: DataFrame, digits: int = 12) -> DataFrame:
    """fam, name, mean_d: the leaf with the greatest mean distance (fam, name, other, d), as far as ``digits`` decimals tell; ties go to the lesser name."""
    mean = distances.groupBy("fam", "name").agg(F.avg("d").alias("mean_d"))
    best = mean.groupBy("fam").agg(F.min(F.struct(-F.round("mean_d", digits), "name", "mean_d")).alias("x"))
    return best.select("fam", "x.name", "x.mean_d")


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of any part, each once."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def in_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both sides."""
    return left.intersect(right)


def interleaved(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Adds round: each group's rows in hash order, one a round; reading by round takes a row of every group in turn."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(draw(key, seed=seed), key)) - 1)


def shards(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Adds shard and place: rows dealt to ``n`` shards by a hash, and shuffled within each by the same one."""
    dealt = rows.withColumn("_h", draw(key, seed=seed)).withColumn("shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % n)
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("_h", key)) - 1).drop("_h")


def beam(rows: DataFrame, group: str, score: str, key: str, width: int) -> DataFrame:
    """Adds rank: the ``width`` best-scored rows of each group, equal scores by key."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    return ranked.where(F.col("rank") <= width)
