"""Order MinHash fingerprints, sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence within the text.  One hash of the numbered
k-mer gives its order and, by its leading bits, one of ``bins`` independent selections; each
selection takes its ``ell`` smallest k-mers, puts them back into text order and hashes that tuple to
16 bits.  Two texts agree in a selection only where the same k-mers stand in the same order, so
moved passages count as edits, unlike in plain MinHash.

Defined results: a text shorter than k is one k-mer; an empty or null text selects nothing; a
selection that is empty in both texts doesn't count; two empty texts have likeness 1.0, an empty and
a nonempty one 0.0.  Rows with equal ids are ordered by their texts.  A null id sorts first.  Rows equal
in id and text follow one another and are judged one by one, all in one task; an empty table gives no rows;
columns other than the id and text are ignored.  A text above 1 MB is a slice of its own, which takes about
150 bytes of memory a letter; all of its k-mers count.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare, shuffle_partitions

K, ELL, BIN_BITS = 10, 2, 6
EMPTY = 0  # a selection without a k-mer


def signatures(texts: list[str], k: int = K, ell: int = ELL, bin_bits: int = BIN_BITS) -> np.ndarray:
    """A row of 2**bin_bits 16-bit values for each text."""
    bins = 1 << bin_bits
    out = np.zeros((len(texts), bins), np.uint16)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out
    lengths = np.array([len(t) for t in texts])
    n = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    rows = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(n.sum()) + ((np.cumsum(lengths) - lengths) - (np.cumsum(n) - n))[rows]
    sums = _text.prefix_sums(_text.mix(codes.astype(np.uint64) + np.uint64(1)))
    kmers = _text.span_hash(sums, pos, pos + np.minimum(k, lengths)[rows])

    order = by_hash_and_place(kmers, rows, len(texts))
    first = np.concatenate([[True], (kmers[order[1:]] != kmers[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])])
    index = np.arange(len(order))
    numbered = np.empty(len(order), np.uint64)
    numbered[order] = _text.mix(kmers[order] + (index - np.maximum.accumulate(np.where(first, index, 0))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    # by row and numbered hash, whose leading bits are the selection
    chosen = by_hash_and_place(numbered, rows, len(texts))
    group = rows[chosen] << bin_bits | (numbered[chosen] >> np.uint64(64 - bin_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.minimum(np.diff(np.concatenate([first, [len(group)]])), ell)
    picks = np.full((len(first), ell), len(pos), np.int64)
    for j in range(ell):
        have = size > j
        picks[have, j] = chosen[first[have] + j]
    picks.sort(1)
    padded = np.append(kmers, np.uint64(0))
    tuples = np.zeros(len(first), np.uint64)
    for j in range(ell):
        tuples = _text.mix(tuples * np.uint64(0x9E3779B97F4A7C15) + padded[picks[:, j]] + np.uint64(j + 1))
    values = (tuples >> np.uint64(48)).astype(np.uint16)
    out[rows[picks[:, 0]], group[first] & (bins - 1)] = np.where(values == EMPTY, 1, values)
    return out


def by_hash_and_place(hashes: np.ndarray, rows: np.ndarray | None = None, n_rows: int = 0) -> np.ndarray:
    """Indices in the order of rows, of all 64 bits of the hashes within one, and of equal ones by place.

    Rows, leading bits and places are sorted as one number; where different hashes share all of those bits,
    which is rare, their runs are sorted again in full.
    """
    at_bits, row_bits = int(len(hashes)).bit_length(), int(n_rows).bit_length()
    mask = np.uint64((1 << at_bits) - 1)
    key = (hashes >> np.uint64(row_bits)) & ~mask | np.arange(len(hashes), dtype=np.uint64)
    if row_bits:
        key |= rows.astype(np.uint64) << np.uint64(64 - row_bits)
    key.sort()
    order = (key & mask).astype(np.int64)
    lead, full = key >> np.uint64(at_bits), hashes[order]
    same = lead[1:] == lead[:-1]
    wrong = same & (full[1:] != full[:-1])
    if wrong.any():
        run = np.concatenate([[0], np.cumsum(~same)])
        mixed = np.flatnonzero(np.isin(run, run[1:][wrong]))
        order[mixed] = order[mixed][np.lexsort((order[mixed], full[mixed], run[mixed]))]
    return order


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the selections on which the rows of ``a`` and ``b`` agree, of those nonempty in either."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(used > 0, equal / np.maximum(used, 1), 1.0)


def fingerprint(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint, a hexadecimal string, to every row of ``docs``."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        made = []
        for _, _, part in _strings(pa.array(texts, pa.string())):
            made += [s.astype(">u2").tobytes().hex() for s in signatures(part)]
        return pd.Series(made, dtype=object)

    return docs.withColumn(out, run(F.col(text_col)))


def _strings(texts: pa.Array):
    for lo, hi, _, _ in _text.slices(texts):
        yield lo, hi, texts.slice(lo, hi - lo).fill_null("").to_pylist()


def cut_points(docs: DataFrame, buckets: int) -> list[tuple]:
    """Sorted keys (id is known, id, text's beginning) at which ranges of about equal size begin.

    They come from quantiles of the ids and, for each id that more rows than a range should hold share,
    of the beginnings of its texts; both number at most about ``buckets``.
    """
    if buckets < 2:
        return []
    shares = (np.arange(1, buckets) / buckets).tolist()
    total, ids = docs.agg(F.count("*"), F.percentile_approx("_id", shares)).first()
    cuts = {(True, i, 0) for i in ids or []}
    hot = docs.groupBy("_id").count().where(F.col("count") > total / buckets)
    if not hot.isEmpty():
        # fewer than `buckets` ids are that frequent
        known = docs.join(F.broadcast(hot.select(F.col("_id").alias("_hot"))), F.col("_id").eqNullSafe(F.col("_hot")))
        for r in known.groupBy("_id").agg(F.percentile_approx("_start", shares).alias("starts")).collect():
            cuts |= {(r._id is not None, r._id or 0, s) for s in r.starts}
    return sorted(cuts)


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Deals rows into ranges of id and text, each followed by a copy of the first row of the next range.

    Columns _bucket, _copy, _id, _text; every partition is sorted by them, so each row's successor
    follows it in its own task.  The driver holds one key for each range.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    start = F.rpad(F.hex(F.substring(F.encode(F.substring("_text", 1, 7), "utf-8"), 1, 7)), 14, "0")
    docs = docs.withColumn("_start", F.conv(start, 16, 10).cast("long"))
    cuts = cut_points(docs, buckets)

    def place(ids: pa.Array, starts: pa.Array) -> list[int]:
        return [bisect.bisect_right(cuts, (i is not None, i or 0, s)) for i, s in zip(ids.to_pylist(), starts.to_pylist(), strict=True)]

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(*b.columns), pa.int64()), *b.columns], ["_bucket", "_id", "_start"])

    # each range's least id and text's beginning, then the least text among the rows that share both
    least = docs.select("_id", "_start").mapInArrow(placed, "_bucket long, _id long, _start long").groupBy("_bucket").agg(F.min(F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_start")).alias("f"))
    least = least.select("_bucket", F.col("f._id").alias("_first"), F.col("f._start").alias("_begin"))
    texts = docs.join(F.broadcast(least), F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_start") == F.col("_begin"))).groupBy("_bucket").agg(F.min("_first").alias("_first"), F.sha2(F.min("_text"), 256).alias("digest"))
    firsts = sorted(map(tuple, texts.select("_bucket", "_first", "digest").collect()))
    before = {(i, digest): firsts[at - 1][0] for at, (_, i, digest) in enumerate(firsts)}
    heads = {i for i, _ in before}

    def deal(batches):
        sent: set[int] = set()
        for b in batches:
            bucket = place(b.column(0), b.column(2))
            copy, at = [False] * len(bucket), [*range(len(bucket))]
            for n, i in enumerate(b.column(0).to_pylist()):
                to = before.get((i, hashlib.sha256(b.column(1)[n].as_buffer()).hexdigest())) if i in heads else None
                if to is not None and to not in sent:  # one copy from each task is enough
                    sent.add(to)
                    bucket.append(to)
                    copy.append(True)
                    at.append(n)
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(copy, pa.bool_()), rows.column(0), rows.column(1)], ["_bucket", "_copy", "_id", "_text"])

    dealt = docs.mapInArrow(deal, "_bucket long, _copy boolean, _id long, _text string")
    return dealt.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_copy", F.col("_id").asc_nulls_first(), "_text")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next text's are."""
    spark = prepare(docs.sparkSession)
    ordered = with_next(docs, id_col, text_col, buckets or 2 * shuffle_partitions(spark))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the last row so far: bucket, copy, id, text, signature
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:3]]
            for lo, hi, texts in _strings(b.column(3)):
                rows = list(zip(*(c[lo:hi] for c in cols), texts, signatures(texts), strict=True))
                rows = [held, *rows] if held else rows
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                if not pairs:
                    continue
                new = [edited(x[3], y[3]) for x, y in pairs]
                own, other, changed = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs]), signatures(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                        *(pa.array([s.astype(">u2").tobytes().hex() for s in part]) for part in (own, changed)),
                        pa.array(likeness(own, changed)), pa.array(likeness(own, other)),
                    ], names)

    return ordered.mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
