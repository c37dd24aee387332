"""Counts over alignment columns: transitions, residues, adjacencies, gaps, bigrams, composition.

All are one pass of window and hash-aggregate operators over (pair_id, pos, st, a, b); a partial sum
per task precedes every shuffle of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MATCH, INSERT, DELETE, END = 0, 1, 2, 3, 4
NAMES = ["S", "M", "I", "D", "E"]
PIECE = 4 << 20  # bytes of text that a task counts at once


def by_pair():
    return Window.partitionBy("pair_id").orderBy("pos")


def classify(a_gap: Column, b_gap: Column) -> Column:
    """State of a column by which of its rows has a gap; null where both have."""
    return F.when(~a_gap & ~b_gap, MATCH).when(a_gap & ~b_gap, INSERT).when(~a_gap & b_gap, DELETE)


def transitions(columns: DataFrame) -> DataFrame:
    """pair_id, src, dst of every step of every pair, from start to end; a pair's last column also steps to the end."""
    stepped = columns.select("pair_id", F.lag("st", 1, START).over(by_pair()).alias("src"), F.col("st").alias("dst"), F.lead("st").over(by_pair()).isNull().alias("last"))
    steps = F.when(F.col("last"), F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.lit(END).alias("dst")))).otherwise(F.array(F.struct("src", "dst")))
    return stepped.select("pair_id", F.explode(steps).alias("s")).select("pair_id", "s.src", "s.dst")


def placed_transitions(columns: DataFrame) -> DataFrame:
    """pair_id, pos, src, dst: the steps of ``transitions`` with the column that each leads to."""
    stepped = columns.select("pair_id", "pos", F.lag("st", 1, START).over(by_pair()).alias("src"), F.col("st").alias("dst"), F.lead("st").over(by_pair()).isNull().alias("last"))
    step, end = F.struct("pos", "src", "dst"), F.struct((F.col("pos") + 1).alias("pos"), F.col("dst").alias("src"), F.lit(END).alias("dst"))
    return stepped.select("pair_id", F.explode(F.when(F.col("last"), F.array(step, end)).otherwise(F.array(step))).alias("s")).select("pair_id", "s.*")


def transition_counts(columns: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """n of each (by, src, dst); ``groups`` has a row (pair_id, by ...) for each pair.

    Each pair's steps are counted where its columns already are, so the join moves at most 25 rows a pair.
    """
    per_pair = transitions(columns).groupBy("pair_id", "src", "dst").agg(F.count("*").alias("n"))
    return per_pair.join(groups, "pair_id").groupBy(*by, "src", "dst").agg(F.sum("n").alias("n"))


def match_counts(columns: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """n of each (by, a, b) over match columns."""
    return columns.where(F.col("st") == MATCH).join(groups, "pair_id").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def singlet_counts(columns: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """n of each (by, c): the residues of inserts and deletes together."""
    residue = F.when(F.col("st") == INSERT, F.col("b")).otherwise(F.col("a"))
    return columns.where(F.col("st") != MATCH).withColumn("c", residue).join(groups, "pair_id").groupBy(*by, "c").agg(F.count("*").alias("n"))


def flipped(columns: DataFrame) -> DataFrame:
    """The columns with the two rows exchanged: inserts become deletes."""
    st = F.when(F.col("st") == INSERT, DELETE).when(F.col("st") == DELETE, INSERT).otherwise(F.col("st"))
    return columns.select("pair_id", "pos", st.alias("st"), F.col("b").alias("a"), F.col("a").alias("b"))


def adjacency_counts(columns: DataFrame, *, symmetric: bool = False) -> DataFrame:
    """n of each adjacency (key, a1, b1, a2, b2): two neighbouring columns' states and emitted residues.

    A residue that a state doesn't emit is null, and so are those of start and end.  ``symmetric``
    adds the counts of the flipped pairs, which are the counts themselves under exchanged keys.
    """
    w = by_pair()
    a, b = F.when(F.col("st") != INSERT, F.col("a")), F.when(F.col("st") != DELETE, F.col("b"))
    here = F.struct(F.col("st").alias("s"), a.alias("a"), b.alias("b"))
    rows = columns.select("pair_id", here.alias("x"), F.lag(here).over(w).alias("p"), F.lead(here).over(w).isNull().alias("last"))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(START).alias("s"), none.alias("a"), none.alias("b"))
    end = F.struct(F.lit(END).alias("s"), none.alias("a"), none.alias("b"))
    into = F.struct(F.coalesce("p", start).alias("u"), F.col("x").alias("v"))
    both_steps = F.when(F.col("last"), F.array(into, F.struct(F.col("x").alias("u"), end.alias("v")))).otherwise(F.array(into))
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), F.col(c) + 1)
    steps = rows.select(F.explode(both_steps).alias("e")).select(F.concat(name("e.u.s"), name("e.v.s")).alias("key"), F.col("e.u.a").alias("a1"), F.col("e.u.b").alias("b1"), F.col("e.v.a").alias("a2"), F.col("e.v.b").alias("b2"))
    keys = ["key", "a1", "b1", "a2", "b2"]
    n = steps.groupBy(*keys).agg(F.count("*").alias("n"))
    if not symmetric:
        return n
    turned = F.struct(F.translate("key", "ID", "DI").alias("key"), F.col("b1").alias("a1"), F.col("a1").alias("b1"), F.col("b2").alias("a2"), F.col("a2").alias("b2"))
    return n.select(F.explode(F.array(F.struct(*keys), turned)).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).select("k.*", "n")


def gap_tally(columns: DataFrame, clip: int) -> DataFrame:
    """n of each (kind, i, j): segments between matches with i deletes and j inserts, both clipped.

    kind is SM before the first match, MM between two, ME after the last, and SE without any; empty
    segments count too.
    """
    match = F.col("st") == MATCH
    seen = F.sum(match.cast("int")).over(by_pair())
    total = F.sum(match.cast("int")).over(Window.partitionBy("pair_id"))
    # a pair that begins with a match has no rows before it: its empty first segment is added
    head = F.lag("st").over(by_pair()).isNull() & match
    marked = columns.select("pair_id", total.alias("total"), head.alias("head"), F.struct(seen.alias("seen"), "st").alias("r"))
    empty = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(MATCH).alias("st"))
    rows = marked.select("pair_id", "total", F.explode(F.when(F.col("head"), F.array(empty, F.col("r"))).otherwise(F.array("r"))).alias("r"))
    of = lambda st: F.sum((F.col("r.st") == st).cast("int"))
    segments = rows.groupBy("pair_id", F.col("r.seen").alias("seen"), "total").agg(of(DELETE).alias("i"), of(INSERT).alias("j"))
    kind = F.when(F.col("total") == 0, "SE").when(F.col("seen") == 0, "SM").when(F.col("seen") == F.col("total"), "ME").otherwise("MM")
    every = segments.select(kind.alias("kind"), F.least("i", F.lit(clip)).cast("int").alias("i"), F.least("j", F.lit(clip)).cast("int").alias("j"))
    return every.groupBy("kind", "i", "j").agg(F.count("*").alias("n"))


def _texts(batches, piece: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(batch's number, first row, bytes, offsets) of runs of a batch's texts (its last column; null: empty) of about ``piece`` bytes, one text at least."""
    for number, b in enumerate(batches):
        texts = b.column(b.num_columns - 1).fill_null("").cast(pa.large_string())
        if not len(texts):
            continue
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, "right")) - 1)
            yield number, lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def bigrams(letters: DataFrame, size: int, piece: int = PIECE) -> DataFrame:
    """n of each pair c1, c2 of neighbouring letters of strings s: codes from 0 for ``a`` on, ``size`` and ``size + 1`` for the begin and the end.

    Characters that aren't among the first ``size`` lower-case letters are passed over; a string without any of those has no pairs.
    A task counts its strings' bytes, about ``piece`` of them at a time, into one table and hands on at most (size + 2)^2 rows.
    """
    wide = size + 2

    def run(batches):
        n = np.zeros(wide * wide, np.int64)
        for _, _, data, offsets in _texts(batches, piece):
            kept = np.flatnonzero((data >= 97) & (data < 97 + size))
            code, row = data[kept].astype(np.int64) - 97, np.searchsorted(offsets, kept, "right")
            new = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            last = np.concatenate([new[1:], [True]])[: len(row)]
            before = np.where(new, size, np.concatenate([[0], code[:-1]])[: len(code)])
            n += np.bincount(before * wide + code, minlength=wide * wide) + np.bincount(code[last] * wide + size + 1, minlength=wide * wide)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((found // wide).astype(np.int32)), pa.array((found % wide).astype(np.int32)), pa.array(n[found])], ["c1", "c2", "n"])

    made = letters.select("s").mapInArrow(run, "c1 int, c2 int, n long")
    return made.groupBy("c1", "c2").agg(F.sum("n").alias("n"))


def composition(symbols: DataFrame) -> DataFrame:
    """share of each symbol in its sequence."""
    n = symbols.groupBy("seq_id", "c").agg(F.count("*").alias("n"))
    return n.select("seq_id", "c", (F.col("n") / F.sum("n").over(Window.partitionBy("seq_id"))).alias("share"))


def merged(counts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The sum of count tables over the same keys."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def weighted(counts: DataFrame, weights: DataFrame, on: list[str], component: str, keys: list[str]) -> DataFrame:
    """Counts weighted by responsibilities: the sum of weight * n for each (component, keys)."""
    return counts.join(weights, on).groupBy(component, *keys).agg(F.sum(F.col("weight") * F.col("n")).alias("n"))


def contracted(counts: DataFrame, table: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """loglik of each group: the sum of n * logp over a table of log-probabilities by ``keys``, which has a row per key only."""
    return counts.join(table, keys).groupBy(*by).agg(F.sum(F.col("n") * F.col("logp")).alias("loglik"))


def log_groups(counts: DataFrame, by: list[str]) -> DataFrame:
    """The eight sums of 5x5 transition counts that the link model's log-likelihood is linear in."""
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    src, dst = F.col("src"), F.col("dst")
    to_m, to_d, to_i, to_e = (dst == k for k in (MATCH, DELETE, INSERT, END))
    return counts.groupBy(*by).agg(
        n(to_m).alias("n_alpha"), n(to_d).alias("n_1malpha"), n((src != DELETE) & to_i).alias("n_beta"), n((src != DELETE) & ~to_i).alias("n_1mbeta"),
        n((src == DELETE) & to_i).alias("n_gamma"), n((src == DELETE) & ~to_i).alias("n_1mgamma"), n(to_m | to_d).alias("n_kappa"), n(to_e).alias("n_1mkappa"),
    )


def column_entropy(rows: DataFrame) -> DataFrame:
    """fam, entropy, gap_share, all_gap_share of aligned residues (fam, col, res), null for a gap.

    The entropy in bits is over a column's residues; it and the gap share are means over columns.
    """
    by_res = rows.groupBy("fam", "col", "res").agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("res").isNotNull(), F.col("n")).otherwise(0))
    col = by_res.groupBy("fam", "col").agg(total.alias("full"), F.sum("n").alias("all"), F.sum(F.when(F.col("res").isNotNull(), F.col("n") * F.log2("n"))).alias("nlog"))
    h = F.when(F.col("full") > 0, F.log2("full") - F.col("nlog") / F.col("full")).otherwise(0.0)
    return col.groupBy("fam").agg(F.avg(h).alias("entropy"), F.avg(1 - F.col("full") / F.col("all")).alias("gap_share"), F.avg((F.col("full") == 0).cast("double")).alias("all_gap_share"))


def contingency(columns: DataFrame, groups: DataFrame, by: list[str], gap: int) -> DataFrame:
    """n of each (by, x, y): both rows' residues, ``gap`` standing for a gap."""
    x = F.when(F.col("st") == INSERT, gap).otherwise(F.col("a"))
    y = F.when(F.col("st") == DELETE, gap).otherwise(F.col("b"))
    return columns.select("pair_id", x.alias("x"), y.alias("y")).join(groups, "pair_id").groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def site_counts(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """n of each (site, tau_bin, a, b) over match columns, a site being a column's place."""
    matches = columns.where(F.col("st") == MATCH).join(groups, "pair_id")
    return matches.groupBy(F.col("pos").alias("site"), "tau_bin", "a", "b").agg(F.count("*").alias("n"))


def lifted(counts: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lifted: counts plus a prior's pseudocounts (keys, alpha), over the keys of either side."""
    joined = counts.join(prior, keys, "full")
    return joined.select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("alpha", F.lit(0.0))).alias("lifted"))


def lowered(pseudocounts: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """The counts that ``lifted`` made ``pseudocounts`` of; no count falls below zero."""
    joined = pseudocounts.join(prior, keys, "left")
    return joined.select(*keys, F.greatest(F.col("lifted") - F.coalesce("alpha", F.lit(0.0)), F.lit(0.0)).alias("n"))


def letter_vectors(letters: DataFrame, size: int) -> DataFrame:
    """seq_id, n: how often each of the first ``size`` lower-case letters stands in each string s; strings without any are dropped.

    A task counts bytes, about ``PIECE`` of them at a time.
    """

    def run(batches):
        for b in batches:
            n = np.zeros((b.num_rows, size))
            for _, lo, data, offsets in _texts([b], PIECE):
                kept = np.flatnonzero((data >= 97) & (data < 97 + size))
                row = np.searchsorted(offsets, kept, "right") - 1
                n[lo : lo + len(offsets) - 1] = np.bincount(row * size + (data[kept] - 97), minlength=(len(offsets) - 1) * size).reshape(-1, size)
            some = pa.array(n.any(1))
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, size, dtype=np.int32)), pa.array(n.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["seq_id", "n"]).filter(some)

    seq_id = letters.schema["seq_id"].dataType.simpleString()
    return letters.select("seq_id", "s").mapInArrow(run, f"seq_id {seq_id}, n array<double>")


def letter_shares(vectors: DataFrame, by: str) -> DataFrame:
    """by, c, share of each letter that a group's count vectors (by, n) have, in the whole group; a null group is one too."""
    n = vectors.select(by, F.posexplode("n").alias("c", "x")).groupBy(by, "c").agg(F.sum("x").alias("x")).where("x > 0")
    return n.select(by, "c", (F.col("x") / F.sum("x").over(Window.partitionBy(by))).alias("share"))


def squared_distance(vectors: DataFrame) -> DataFrame:
    """seq_id, d: the squared distance of each count vector's shares from those of all vectors together."""
    width = F.size("n")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    # one row of as many numbers as a vector has
    sums = vectors.select(F.posexplode("n").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x"))
    whole = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("g"))
    share = lambda v: F.transform(v, lambda x: x / total(v))
    both = vectors.withColumn("own", total(F.col("n"))).crossJoin(F.broadcast(whole.select(share(F.col("g")).alias("g")))).where(width == F.size("g"))
    return both.select("seq_id", total(F.zip_with("n", "g", lambda x, y: (x / F.col("own") - y) * (x / F.col("own") - y))).alias("d"))
