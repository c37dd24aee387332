"""Super-k-mers: runs of windows that share a minimiser, and the jobs around them.

A text is a sequence of units (words or bytes).  Its windows of ``k`` units each have a minimiser,
the m-gram of units least in a hashed order, leftmost among equals.  Consecutive windows with the
same minimiser make one super-k-mer, which travels as one packed string to the minimiser's bucket, so
that equal windows of all texts meet there.

Skew: m-grams that make up more than a small share of all units rank last in the order, so a window
that has any rarer m-gram goes to that one's bucket; super-k-mers that repeat are merged before the
shuffle, so a copied passage costs each task one string however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare, stored

NO_ID = (1 << 63) - 1  # stands for a null id, which is greater than any other
BUCKET_BYTES = 3 << 20  # of packed strings that one bucket holds on average
MOST_HOT = 1 << 16  # m-grams that may rank last, and that a task's summary of frequent ones holds
FLUSH_BYTES = 48 << 20  # of distinct strings that a task gathers before it sends them
SECOND_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Plan:
    """What a window is: ``k`` units, minimisers of ``m`` units, of words or else of bytes."""

    k: int
    m: int
    words: bool
    buckets: int = 1
    hot: tuple[int, ...] = ()


class Units:
    """A slice's units as bytes: words joined by single spaces, or the bytes themselves."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, plan: Plan):
        if plan.words:
            words = _text.Words(data, offsets)
            keep = ~_text.SPACE[data]
            after = np.zeros(len(data) + 1, bool)
            after[words.ends] = True
            gap = after[:-1] & ~keep
            self.data = np.where(gap, np.uint8(32), data)[keep | gap]
            place = np.concatenate([[0], np.cumsum(keep | gap)])
            self.starts, self.ends = place[words.starts], place[words.starts] + words.ends - words.starts
            self.first, self.counts = words.first, words.counts
            self.codes = words.hashes()
        else:
            self.data, self.first, self.counts = data, offsets, np.diff(offsets)
            self.starts, self.ends = np.arange(len(data)), np.arange(1, len(data) + 1)
            self.codes = _text.BYTE_CODE[data]
        self.sums = _text.prefix_sums(self.codes)
        self.of_words = plan.words

    def grams(self, m: int) -> np.ndarray:
        """The hash of the m-gram at each unit, those that run over a row's end included."""
        at = np.arange(max(0, len(self.codes) - m + 1))
        return _text.span_hash(self.sums, at, at + m)

    def super_kmers(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first unit, windows, minimiser) of each super-k-mer."""
        n = np.maximum(self.counts - plan.k + 1, 0)
        rows = np.repeat(np.arange(len(n)), n)
        if not len(rows):
            return rows, rows, rows, np.zeros(0, np.uint64)
        begin = np.arange(n.sum()) - (np.cumsum(n) - n)[rows] + self.first[:-1][rows]
        grams = self.grams(plan.m)
        order = ranked(grams)
        if plan.hot:
            hot = np.array(plan.hot, np.uint64)
            at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
            order |= (hot[at] == grams).astype(np.uint64) << np.uint64(63)
        # the place fills the lowest bits, the same number of them in every slice below 2**32 units
        bits = np.uint64(32)
        least = _text.sliding_min(order >> bits << bits | np.arange(len(grams), dtype=np.uint64), plan.k - plan.m + 1)[begin]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])]))
        where = (least[new] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return rows[new], begin[new], np.diff(np.concatenate([new, [len(rows)]])), grams[where]

    def keys(self, begin: np.ndarray, windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end byte, two unrelated 64-bit hashes) of the super-k-mers' strings, over units."""
        end = begin + windows + (k - 1)
        second = _text.prefix_sums(_text.apart_hashes(self.data, self.starts, self.ends, 1) if self.of_words else SECOND_CODE[self.data])
        return self.starts[begin], self.ends[end - 1], _text.span_hash(self.sums, begin, end), _text.span_hash(second, begin, end)


def ranked(grams: np.ndarray) -> np.ndarray:
    """The order of m-grams in which a window's least is its minimiser: 63 bits, unrelated to the buckets."""
    return grams * np.uint64(0x9FB21C651E98DF25) >> np.uint64(1)


def string_keys(data: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes that ``Units.keys`` gives to each of some packed strings, which hold a window or more."""
    one, two = np.empty((2, len(offsets) - 1), np.uint64)
    first = 0
    while first < len(one):  # so that temporary arrays stay small
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _text.SLICE_BYTES, "right")) - 1)
        units = Units(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], plan)
        _, _, one[first:end], two[first:end] = units.keys(units.first[:-1], units.counts - (plan.k - 1), plan.k)
        first = end
    return one, two


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _h, _text: a row is known by its id and its text's hash, so equal rows share their results."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def frequent(counts: dict | None, keys: np.ndarray, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges counts into a summary of at most ``size`` keys, as Misra and Gries do.

    A key's count in the summary falls short of its true count by at most total / size.
    """
    if counts is not None:
        keys, place = np.unique(np.concatenate([counts[0], keys]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([counts[1], sums]), len(keys)).astype(np.int64)
    if len(keys) > size:
        cut = np.partition(sums, len(sums) - size - 1)[len(sums) - size - 1]
        keep = sums > cut
        keys, sums = keys[keep], sums[keep] - cut
    return keys, sums


def planned(docs: DataFrame, plan: Plan) -> Plan:
    """``plan`` with a number of buckets that follows the input and the m-grams too frequent for one bucket.

    An m-gram is too frequent where strings around all its places would fill half a bucket.  Of those the
    ``MOST_HOT`` commonest are taken, which bounds the list; any others only make their buckets larger.
    """
    total = docs.select(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, -(-3 * total // BUCKET_BYTES))
    size = min(64 * buckets + 64, MOST_HOT)
    # a window of w m-grams has one in the first 12 / w of the order but for a chance of e^-12, so
    # only those can be minimisers often, and only they are counted
    early = np.uint64(int(min(1.0, 12 / (plan.k - plan.m + 1)) * ((1 << 63) - 1)))

    def run(batches):
        held = None
        for b in batches:
            for _, _, data, offsets in _text.slices(b.column(0)):
                grams = Units(data, offsets, plan).grams(plan.m)
                grams = grams[ranked(grams) <= early]
                held = frequent(held, *np.unique(grams, return_counts=True), size)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], ["gram", "n"])

    string_bytes = 2 * plan.k * (8 if plan.words else 1)
    sums = docs.select("_text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    common = sums.where(F.col("n") > max(1000, BUCKET_BYTES // (2 * string_bytes))).orderBy(F.desc("n"), "gram").limit(MOST_HOT)
    hot = [r.gram for r in common.select("gram").collect()] if buckets > 4 else []
    return Plan(plan.k, plan.m, plan.words, buckets, tuple(sorted(g % (1 << 64) for g in hot)))


def packed(docs: DataFrame, plan: Plan) -> DataFrame:
    """bucket, blob: each task's distinct super-k-mers, one compressed blob for each bucket it met."""

    def flush(held):
        """Merges the super-k-mers gathered so far; their strings are cut from the texts one bucket at a time."""
        raws = [h[0] for h in held]
        of = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        anchor, one, two, left, right, ids = (np.concatenate([h[k] for h in held]) for k in range(1, 7))
        held.clear()
        bucket = (anchor % np.uint64(plan.buckets)).astype(np.int64)
        order = np.lexsort((two, one, bucket))
        first = np.flatnonzero(np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (bucket[order[1:]] != bucket[order[:-1]])])[: len(order)])
        if not len(first):
            return
        copies = np.minimum(np.diff(np.append(first, len(order))), 2)
        least, greatest = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        head = np.stack([anchor[order[first]], least.view(np.uint64), greatest.view(np.uint64), copies.astype(np.uint64)])
        pick = order[first]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[pick[1:]] != bucket[pick[:-1]]]))
        pack = zstandard.ZstdCompressor(level=1).compress
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pick)], strict=True):
            part = pick[s:e]
            strings = [raws[k][a:b] for k, a, b in zip(of[part].tolist(), left[part].tolist(), right[part].tolist(), strict=True)]
            by = sorted(range(len(strings)), key=strings.__getitem__)
            strings = [strings[k] for k in by]
            blob = np.uint32(len(strings)).tobytes() + head[:, s:e][:, by].tobytes() + np.array([*map(len, strings)], np.uint32).tobytes() + b"".join(strings)
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[part[0]])], pa.int64()), _text.binary([pack(blob)])], ["bucket", "blob"])

    def run(batches):
        held, size = [], 0  # of each slice: its bytes and its super-k-mers
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, offsets in _text.slices(b.column(1)):
                units = Units(data, offsets, plan)
                rows, begin, windows, anchor = units.super_kmers(plan)
                if not len(rows):
                    continue
                left, right, one, two = units.keys(begin, windows, plan.k)
                held.append((units.data.tobytes(), anchor, one, two, left, right, ids[lo + rows]))
                size += int((right - left).sum())
                if size > FLUSH_BYTES:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return docs.select("_id", "_text").mapInArrow(run, "bucket long, blob binary")


@dataclass
class Bucket:
    """The distinct super-k-mers of a bucket."""

    data: np.ndarray
    offsets: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    copies: np.ndarray


def unpacked(blobs: list[bytes]) -> Bucket:
    heads, texts = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        heads.append(np.frombuffer(raw, np.uint64, 4 * n, 4).reshape(4, n))
        lengths = np.frombuffer(raw, np.uint32, n, 4 + 32 * n)
        ends = np.cumsum(lengths) + 4 + 36 * n
        texts += [raw[e - k : e] for k, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
    anchor, least, greatest, copies = np.concatenate(heads, 1) if heads else np.zeros((4, 0), np.uint64)
    least, greatest, copies = least.view(np.int64), greatest.view(np.int64), copies.astype(np.int64)
    code: dict[bytes, int] = {}
    name = np.array([code.setdefault(t, len(code)) for t in texts], np.int64)
    n = len(code)
    low, high, sums, anchors = np.full(n, NO_ID), np.full(n, -NO_ID), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    np.minimum.at(low, name, least)
    np.maximum.at(high, name, greatest)
    np.add.at(sums, name, copies)
    anchors[name] = anchor
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in code])]).astype(np.int64)
    data = np.frombuffer(b"".join(code), np.uint8)
    return Bucket(data, offsets, anchors, low, high, sums)


RUNS = "array<struct<a:int,b:int,doc:long>>"


def judged(docs: DataFrame, plan: Plan, judge: Callable[[Bucket], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """k1, k2, runs: of each super-k-mer, the windows a..b-1 that ``judge`` marks, with the id it gives them.

    ``judge`` returns (super-k-mer, a, b, id) arrays in the order of the super-k-mers.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = unpacked(group["blob"].to_pylist())
        which, a, b, doc = judge(bucket)
        keys, at = np.unique(which, return_index=True)
        lengths = np.diff(bucket.offsets)[keys]
        ends = np.cumsum(lengths)
        chosen = bucket.data[np.arange(lengths.sum()) + np.repeat(bucket.offsets[keys] - (ends - lengths), lengths)]
        one, two = string_keys(chosen, np.concatenate([[0], ends]), plan)
        runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(which)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(doc, pa.int64())], ["a", "b", "doc"]))
        return pa.Table.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), runs], ["k1", "k2", "runs"])

    return packed(docs, plan).groupBy("bucket").applyInArrow(run, f"k1 long, k2 long, runs {RUNS}")


def occurrences(docs: DataFrame, plan: Plan) -> DataFrame:
    """_id, _h, k1, k2, first: every place of every super-k-mer, without its string."""
    names = ["_id", "_h", "k1", "k2", "first"]

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(2)):
                units = Units(data, offsets, plan)
                rows, begin, windows, _ = units.super_kmers(plan)
                _, _, one, two = units.keys(begin, windows, plan.k)
                at = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array((begin - units.first[rows]).astype(np.int64))], names)

    return docs.select("_id", "_h", "_text").mapInArrow(run, "_id long, _h long, k1 long, k2 long, first long")


def covered(docs: DataFrame, plan: Plan, marks: DataFrame, later_only: bool) -> DataFrame:
    """_id, _h, spans: the units of each row that marked windows cover; ``later_only``: only where its id is greater than the mark's."""
    hits = occurrences(docs, plan).join(marks, ["k1", "k2"]).select("_id", "_h", "first", F.explode("runs").alias("r"))
    if later_only:
        hits = hits.where(F.col("r.doc") < F.col("_id"))
    span = F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + (plan.k - 1)).alias("b"))
    return hits.groupBy("_id", "_h").agg(F.collect_set(span).alias("spans"))


def cut(docs: DataFrame, spans: DataFrame, run: Callable, id_col: str, schema: str) -> DataFrame:
    """Joins spans to whole texts and applies ``run``; each row's spans are bounded by its own text."""
    joined = docs.join(spans, ["_id", "_h"], "left").select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col), "_text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    return joined.mapInArrow(run, schema)


def spans_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's span starts and ends."""
    out = []
    for x, y in zip(batch.column(2), batch.column(3), strict=True):
        out.append((x.values.to_numpy(), y.values.to_numpy()) if x.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:n] > 0


def marked(docs: DataFrame, plan: Plan, judge: Callable, name: str) -> tuple[DataFrame, Plan]:
    prepare(docs.sparkSession)
    plan = planned(docs, plan)
    return stored(judged(docs, plan, judge), name), plan
