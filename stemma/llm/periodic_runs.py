"""Periodic runs of words, by Lyndon words under both orders.

Phase one of Baier's suffix sorter keeps suffixes in groups of equal context and hands the context of
a group on to the suffixes right before its members, a group's equal neighbours together; what every
suffix ends with is its longest Lyndon prefix.  Groups with nothing pending beside them don't affect
one another, so here a round treats all of them in all texts of a slice at once, rather than one group
after another.  This is done under an order of the words and under its inverse.  Every run has a
Lyndon word of its period's length under one of the two as a root; each such root is extended to both
sides by longest common extensions.

Words are told apart exactly and ordered by a mixed number, so that sorted lists, the worst case of one
order, don't take a round for every word.  Extensions compare polynomial hashes; every run found is
compared word by word afterwards, and a slice with a wrong one is done again with other bases.

Defined results: a null text and one without words have no runs and collapse to the empty text; equal
rows are judged one by one; a null id comes back null and such a text is never made periodic; an empty
table gives no rows; columns other than the id and text are ignored.  A text is never cut: one longer
than a slice is a slice of its own, which takes about 150 bytes of memory a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE_BYTES = 4 << 20
PRIMES = (2147483647, 2147483629)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``prime``, by doubling; kept per process for texts of usual length."""
    have = _powers.get((base, prime), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * (int(have[-1]) * base % prime) % prime])
    if len(have) <= 1 << 21:
        _powers[base, prime] = have
    return have


class Extensions:
    """Longest common extensions of places in a sequence of numbers, by prefix hashes and binary search."""

    def __init__(self, codes: np.ndarray, attempt: int = 0):
        self.codes, self.parts = codes, []
        for k, prime in enumerate(PRIMES):
            base = int(_text.mix(np.array([2 * attempt + k + 1], np.uint64))[0]) % (prime - 1000) + 500
            power = powers(base, prime, len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum((codes % np.uint64(prime)).astype(np.int64) * power[: len(codes)] % prime, out=sums[1:])
            self.parts.append((prime, power, sums))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` numbers from a and from b > a agree."""
        out = np.ones(len(a), bool)
        for prime, power, sums in self.parts:
            out &= (sums[a + n] - sums[a]) % prime * power[b - a] % prime == (sums[b + n] - sums[b]) % prime
        return out

    def _search(self, most: np.ndarray, agree) -> np.ndarray:
        """For each item the greatest n <= most for which agree(items, n) holds, as it does for all smaller ones."""
        low, high = np.zeros(len(most), np.int64), np.asarray(most, np.int64).copy()
        step = 4
        at = np.flatnonzero(low < high)  # gallop, so that short extensions take few steps
        while len(at):
            n = np.minimum(low[at] + step, high[at])
            yes = agree(at, n)
            high[at[~yes]] = n[~yes] - 1
            low[at[yes]] = n[yes]
            at, step = at[yes & (n < high[at])], step * 4
        at = np.flatnonzero(low < high)
        while len(at):
            n = (low[at] + high[at] + 1) // 2
            yes = agree(at, n)
            low[at[yes]], high[at[~yes]] = n[yes], n[~yes] - 1
            at = at[low[at] < high[at]]
        return low

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers from a on equal those from b > a on, at most ``most``."""
        return self._search(most, lambda at, n: self.equal(a[at], b[at], n))

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before a equal those before b > a, at most ``most``."""
        return self._search(most, lambda at, n: self.equal(a[at] - n, b[at] - n, n))


def lyndon_lengths(ext: Extensions, begin: np.ndarray, end: np.ndarray, flip: bool) -> np.ndarray:
    """The length of the longest Lyndon word from each place on, under the order of the codes or its inverse.

    ``begin`` and ``end`` have, for each place, where its text begins and ends.  A prefix comes before what it
    begins, under both orders.
    """
    codes = ~ext.codes if flip else ext.codes
    n = len(codes)
    place = np.arange(n)
    length = np.ones(n, np.int64)
    before = np.where(place > begin, place - 1, -1)
    settled, again = np.zeros(n, bool), np.zeros(n, bool)
    equals_end = np.zeros(n, np.int64)  # of a settled place: where the stretch of equal contexts that begins there ends
    work = place
    while len(work):
        after = work + length[work]
        last = after == end[work]
        equals_end[work[last]] = after[last]
        i, j = work[~last], after[~last]
        mine, other = codes[i], codes[j]
        less, equal, prefix = mine < other, np.zeros(len(i), bool), np.zeros(len(i), bool)
        same = np.flatnonzero(mine == other)
        if len(same):
            a, b = i[same], j[same]
            most = np.minimum(length[a], length[b])
            common = ext.right(a, b, most)
            whole = common == most
            inside = np.minimum(common, most - 1)
            less[same] = np.where(whole, length[a] < length[b], codes[a + inside] < codes[b + inside])
            equal[same] = whole & (length[a] == length[b])
            prefix[same] = whole & (length[b] <= length[a])
        ready = settled[j]
        # a context that can still grow decides only where it isn't a prefix
        settles = ~less & (ready | ~prefix)
        takes = less & ready
        equals_end[i[settles]] = np.where(equal[settles], equals_end[j[settles]], j[settles])
        taker, to = i[takes], equals_end[j[takes]]
        length[taker] = to - taker
        inner = to < end[taker]
        before[to[inner]] = taker[inner]
        done = np.concatenate([work[last], i[settles]])
        settled[done] = True
        waiting = np.concatenate([before[done], *(_repeats(ext, codes, begin, end, int(i), length, before, settled, equals_end) for i in _repeated(codes, done, length, before, settled, equals_end))])
        waiting = waiting[waiting >= 0]
        again[taker] = True
        waiting = waiting[~(settled[waiting] | again[waiting])]
        again[taker] = False
        work = np.concatenate([taker, waiting])
    return length


def _repeated(codes, done, length, before, settled, equals_end) -> np.ndarray:
    """Of the places just settled those that two waiting contexts of one length, with the same first word, stand before."""
    one = before[done]
    two = before[np.maximum(one, 0)]
    maybe = (one >= 0) & (two >= 0) & (codes[one] == codes[two]) & (length[one] == length[two]) & ~settled[one] & ~settled[two]
    return done[maybe & (codes[one] == codes[done]) & (equals_end[done] == done + length[done])]


def _repeats(ext, codes, begin, end, i, length, before, settled, equals_end) -> np.ndarray:
    """Settles all ``k`` copies of a context before the place ``i``, which begins with it, at once rather than in k rounds.

    That holds for as many as what follows i isn't greater than what comes of them; the longest may equal it.
    Returns the place to look at next.
    """
    at = lambda *x: [np.array([v]) for v in x]
    p = int(before[i])
    q, after = i - p, int(i + length[i])
    inner = after < end[i]
    if length[i] <= q or inner and not settled[after] or not ext.equal(*at(p, i, q))[0]:
        return np.zeros(0, np.int64)
    copies = p - q * np.arange(1 + int(ext.left(*at(p, i, p - begin[p]))[0]) // q)
    wrong = np.flatnonzero((length[copies] != q) | settled[copies])
    copies, equal = copies[: wrong[0]] if len(wrong) else copies, False
    while inner and len(copies):
        top = int(copies[-1])
        most = min(after - top, int(length[after]))
        common = int(ext.right(*at(top, after, most))[0])
        equal = common == most and length[after] == after - top
        if equal or (length[after] < after - top if common == most else codes[after + common] < codes[top + common]):
            break
        copies = copies[: len(copies) // 2]
    if not len(copies):
        return np.zeros(0, np.int64)
    length[copies], settled[copies], equals_end[copies] = after - copies, True, after
    if equal:
        equals_end[copies[-1]] = equals_end[after]
    return before[copies[-1:]]


def runs(codes: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts that begin at ``offsets``, in order of start and period.

    A run has its smallest period, is as long as ``min_length`` and ``min_exponent`` (2 or more) periods, and
    can't be extended.
    """
    sizes = np.diff(offsets)
    begin, end = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    for attempt in range(8):
        ext = Extensions(codes, attempt)
        found = []
        for flip in (False, True):
            period = lyndon_lengths(ext, begin, end, flip)
            i = np.flatnonzero(np.arange(len(codes)) + max(1, min_exponent - 1) * period <= end - (min_exponent == 2))
            i = i[codes[i] == codes[np.minimum(i + period[i], len(codes) - 1)]] if min_exponent > 2 else i
            q = period[i]
            i = i[ext.equal(i, i + q, (min_exponent - 2) * q)] if min_exponent > 2 else i[i + q < end[i]]
            root = np.zeros(len(codes), bool)
            root[i] = True
            earlier = i - period[i]
            again = (earlier >= begin[i]) & root[np.maximum(earlier, 0)] & (period[np.maximum(earlier, 0)] == period[i])
            if min_exponent > 2:
                i = i[~again]  # the root before it stands in the same run
            q = period[i]
            right = i + q + ext.right(i, i + q, end[i] - i - q)
            left = i - ext.left(i, i + q, i - begin[i])
            fits = right - left >= np.maximum(min_length, min_exponent * q)
            found.append(np.stack([left[fits], right[fits], q[fits]]))
        start, stop, q = np.unique(np.concatenate(found, 1), axis=1) if len(codes) else np.zeros((3, 0), np.int64)
        order = np.lexsort((q, start))
        start, stop, q = start[order], stop[order], q[order]
        if _periodic(codes, begin, end, start, stop, q):
            return start, stop, q
    raise RuntimeError("hashes of all bases collide")


def _periodic(codes, begin, end, start, stop, q) -> bool:
    """Word by word: every run has its period, and neither neighbour keeps it."""
    n = stop - start - q
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if (codes[at] != codes[at + np.repeat(q, n)]).any():
        return False
    lefts, rights = start > begin[start] if len(start) else start > 0, stop < end[start] if len(start) else stop > 0
    return not ((codes[start[lefts] - 1] == codes[start[lefts] - 1 + q[lefts]]).any() or (codes[stop[rights]] == codes[stop[rights] - q[rights]]).any())


def exact_codes(words: _text.Words) -> np.ndarray:
    """A number for each word, the same for equal words only, in no order that texts are likely to follow."""
    sizes = words.ends - words.starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    solid = words.data[~_text.SPACE[words.data]]
    spelled = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return _text.mix(spelled.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1))


def rewritten(words: _text.Words, hashes: list[int | None]) -> np.ndarray:
    """Which original word stands at each place once texts are made periodic.

    Of h, the hash of a text of n words, g = floor(h / 10): where h % 10 = 0, the words from a = g % n on
    repeat the p = 1 + floor((n - a) / (3 + g % 8)) words from there.
    """
    source = np.arange(len(words))
    for h, lo, n in zip(hashes, words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return source


def joined(words: _text.Words, source: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept words, every word followed by a space."""
    chosen = source[keep]
    size = words.ends[chosen] - words.starts[chosen] + 1
    ends = np.cumsum(size)
    at = np.repeat(words.starts[chosen] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    raw = words.data[np.minimum(at, max(len(words.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    raw[ends - 1] = 0x20
    counts = np.add.reduceat(np.append(keep, False).astype(np.int64), words.first[:-1]) * (words.counts > 0) if len(words.counts) else np.zeros(0, np.int64)
    return raw, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length / period; of equals the one that starts first, then of the smallest period."""
    top = found[0]
    for run in found[1:]:
        mine, other = run[1] * top[2], top[1] * run[2]
        if mine > other or mine == other and (run[0], run[2]) < (top[0], top[2]):
            top = run
    return top


def slices(batch: pa.RecordBatch, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]]:
    """For rows lo to hi of a batch of (id, h, text): the runs of each as (start, length, period), collapsed bytes and their offsets."""
    hashes = batch.column(1).to_pylist()
    for lo, hi, data, offsets in _text.slices(batch.column(2), SLICE_BYTES):
        words = _text.Words(data, offsets)
        source = rewritten(words, hashes[lo:hi])
        start, stop, q = runs(exact_codes(words)[source], words.first, min_length, min_exponent)
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, start + q, 1)
        np.add.at(gone, stop, -1)
        raw, at = joined(words, source, np.cumsum(gone[:-1]) == 0)
        row = np.searchsorted(words.first, start, "right") - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
        for r, s, n, p in zip(row.tolist(), (start - words.first[row]).tolist(), (stop - start).tolist(), q.tolist(), strict=True):
            found[r].append((s, n, p))
        yield lo, hi, found, raw, at


def _prepared(docs: DataFrame, id_col: str, text_col: str, rewrite: Column | None) -> DataFrame:
    prepare(docs.sparkSession)
    h = F.lit(None).cast("long") if rewrite is None else rewrite.cast("long")
    return docs.select(F.col(id_col).alias("_id"), h.alias("_h"), F.col(text_col).cast("string").alias("_text"))


def run_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """id, start, length and period (in words) of every run; texts without one give no rows."""
    rows = _prepared(docs, id_col, text_col, None)

    def made(batches):
        for b in batches:
            for lo, hi, found, _, _ in slices(b, min_length, min_exponent):
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(flat[:, k]) for k in range(3))], [id_col, "start", "length", "period"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(made, f"`{id_col}` {kind}, start long, length long, period long")


def collapsed_texts(docs: DataFrame, *, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with every run cut to its first period; words are joined by one space, null texts stay null."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def collapse(texts):
        import pandas as pd

        column = pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column)), pa.nulls(len(column), pa.int64()), column], ["_id", "_h", "_text"])
        out = [raw[a : max(a, b - 1)].tobytes().decode() for _, _, _, raw, at in slices(batch, min_length, min_exponent) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pd.Series([None if t is None else o for t, o in zip(column.to_pylist(), out, strict=True)], dtype=object)

    return docs.withColumn(text_col, collapse(F.col(text_col).cast("string")))


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, rewrite: Column | None = None) -> DataFrame:
    """One row a document: its number of runs, the run of greatest exponent, digests of all runs and of the collapsed text.

    ``rewrite``, a column of unsigned hashes, makes texts periodic first, as ``rewritten`` says.
    """
    rows = _prepared(docs, id_col, text_col, rewrite)
    names = ["n_runs", "start", "length", "period", "exponent_milli"]

    def made(batches):
        for b in batches:
            for lo, hi, found, raw, at in slices(b, min_length, min_exponent):
                tops = [best(f) if f else None for f in found]
                columns = [[len(f) for f in found], *([t and t[k] for t in tops] for k in range(3)), [t and 1000 * t[1] // t[2] for t in tops]]
                spelled = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in f).encode()).hexdigest() for f in found]
                kept = [hashlib.sha256(raw[a : max(a, z - 1)]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in columns), pa.array(spelled, pa.string()), pa.array(kept, pa.string())], [id_col, *names, "runs_sha256", "collapsed_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(made, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", runs_sha256 string, collapsed_sha256 string")
