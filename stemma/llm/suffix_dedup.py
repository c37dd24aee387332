"""Removal of repeated substrings by suffix sorting, built column by column for many strings at once.

Strings are the super-k-mers of ``size``-byte windows, so that equal windows of all documents meet in
one bounded bucket.  A bucket's collection is built in rounds: round j inserts one symbol for every
string with at least j of them, the one before its suffix of length j - 1, into the collection's
Burrows-Wheeler transform, and updates the array of common prefixes beside it.  Both live in
sequential files that each round reads and writes anew.  At the end a walk over the transform finds
each suffix's rank; a window repeats where a neighbour's common prefix has ``size`` bytes or where
its whole super-k-mer occurs twice.

Defined results: a null text is empty; a text below ``size`` bytes keeps all of them; repeated rows
are each other's copies; a null id comes back null.  Removal is bytewise, so a kept text may begin
or end inside a character; ``texts=True`` widens cuts to whole characters.  An empty table gives no
rows (``clean_texts``: keeps its columns); other columns are ignored, or passed on by ``clean_texts``, whatever their names.  A text above 1 MB
is a slice of its own, which takes about 60 bytes of memory a letter; all of its strings count.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _superkmers as sk
from . import _text
from ._spark import unused

WINDOW, MINIMISER = 200, 48
COLLECTION_BYTES = 60_000  # so that a collection's blocks mostly number below 2**16 and its columns stay in cache


class Columns:
    """The transform and the common prefixes of a collection, in two files that grow from round to round."""

    def __init__(self, folder: str, kind: np.dtype):
        self.kinds = (kind, np.dtype(np.uint16))
        self.files = [open(os.path.join(folder, name), "w+b", buffering=0) for name in ("bwt", "lcp")]
        self.n = 0

    def write(self, *columns: np.ndarray) -> None:
        """Replaces both columns from the front, in one sequential pass each; they never get shorter."""
        self.n = len(columns[0])
        for file, kind, values in zip(self.files, self.kinds, columns, strict=True):
            file.seek(0)
            left = memoryview(np.ascontiguousarray(values, kind)).cast("B")
            while len(left):
                left = left[file.write(left) :]

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for file, kind in zip(self.files, self.kinds, strict=True):
            file.seek(0)
            out.append(np.fromfile(file, kind, self.n))
        return tuple(out)

    def close(self) -> None:
        for file in self.files:
            file.close()


def collection(symbols: np.ndarray, offsets: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """BWT and common prefixes of the strings symbols[offsets[i]:offsets[i+1]], each with an end mark of its own.

    Symbols are 1 and up; 0 stands in the transform for a string's beginning.  Round j inserts all
    suffixes of length j, so the files grow by one symbol for each string that is long enough.
    """
    m, lengths, kind = len(offsets) - 1, np.diff(offsets), symbols.dtype
    files = Columns(folder, kind)
    before = lambda who, j: np.where(lengths[who] > j, symbols[np.maximum(offsets[1:][who] - 1 - j, 0)], 0).astype(kind) if len(symbols) else np.zeros(len(who), kind)
    who, at = np.arange(m), np.arange(m)
    files.write(before(who, 0), np.zeros(m, np.uint16))
    for j in range(1, int(lengths.max(initial=0)) + 1):
        bwt, lcp = files.read()
        open_ = lengths[who] >= j
        who, at = who[open_], at[open_]
        # after this round the suffixes, in order, stem from the transform's symbols in stable order
        order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        fresh = rank[at]
        n = m + len(order)
        is_new = np.zeros(n + 1, bool)
        is_new[m + fresh] = True
        next_bwt, next_lcp = np.empty(n, kind), np.empty(n, np.uint16)
        next_bwt[~is_new[:n]] = bwt
        next_lcp[~is_new[:n]] = lcp
        next_bwt[m + fresh] = before(who, j)
        # common prefixes change at the new suffixes and at those after them
        changed = np.flatnonzero(is_new[m:n] | np.concatenate([[False], is_new[m : n - 1]]))
        next_lcp[m + changed] = 0
        changed = changed[changed > 0]
        low, high = order[changed - 1], order[changed]
        same = bwt[low] == bwt[high]
        changed, low, high = changed[same], low[same], high[same]
        if len(changed):
            by = np.argsort(low)
            edges = np.stack([low[by] + 1, high[by] + 1], 1).ravel()
            next_lcp[m + changed[by]] = np.minimum.reduceat(np.append(lcp, np.uint16(0)), edges)[::2] + 1
        files.write(next_bwt, next_lcp)
        at = m + fresh
    found = files.read()
    files.close()
    return found


def blocks(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings over blocks of ``width`` bytes: (symbols, offsets, place of each symbol's first byte).

    A string gives ``width`` strings, one for each byte that its blocks may begin at, so that every
    byte begins exactly one block; equal blocks have equal symbols, in the order of their values.
    """
    starts, lengths = offsets[:-1], np.diff(offsets)
    padded = np.append(data, np.zeros(8, np.uint8))
    values = np.ndarray((len(data),), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * width) - 1)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = np.flatnonzero(np.arange(len(data)) + width <= offsets[1:][row]).astype(np.int32)
    row = row[place]
    name = row * np.int32(width) + ((place - starts[row]) % width).astype(np.int32)
    order = np.argsort(name, kind="stable")
    _, symbols = np.unique(values[place[order]], return_inverse=True)
    kind = np.uint16 if symbols.max(initial=0) < 65535 else np.uint32
    counts = np.bincount(name, minlength=len(lengths) * width)
    return (symbols + 1).astype(kind), np.concatenate([[0], np.cumsum(counts)]), place[order]


def repeated(data: np.ndarray, offsets: np.ndarray, size: int, folder: str) -> np.ndarray:
    """For each byte, whether the ``size`` bytes from it also start at another place of the collection.

    Symbols are blocks of the most bytes, 8 at most, that divide ``size``: fewer rounds for the same windows.
    """
    width = next(w for w in range(8, 0, -1) if size % w == 0)
    symbols, cuts, place = blocks(data, offsets, width)
    bwt, lcp = collection(symbols, cuts, folder)
    m, lengths = len(cuts) - 1, np.diff(cuts)
    twin = lcp >= size // width
    twin[:-1] |= twin[1:]
    order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
    step = np.full(len(bwt), -1)
    step[order] = m + np.arange(len(order))
    out = np.zeros(len(data), bool)
    who, at = np.arange(m), np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        open_ = lengths[who] >= j
        who, at = who[open_], step[at[open_]]
        out[place[cuts[1:][who] - j]] = twin[at]
    return out


def twice(bucket: sk.Bucket, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur twice or more.

    Equal windows have equal minimisers, so only super-k-mers that share theirs with another one go
    into a collection; the others repeat as a whole or not at all.
    """
    n = len(bucket.offsets) - 1
    hit = np.zeros(len(bucket.data), bool)
    _, group, members = np.unique(bucket.anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group] > 1) if n else np.zeros(0, int)
    shared = shared[np.argsort(group[shared], kind="stable")]
    lengths = np.diff(bucket.offsets)
    # collections of about COLLECTION_BYTES, each holding all super-k-mers of its minimisers
    size_before = np.cumsum(lengths[shared]) - lengths[shared]
    heads = np.flatnonzero(np.concatenate([[True], group[shared[1:]] != group[shared[:-1]]])) if len(shared) else np.zeros(0, int)
    part = size_before[heads] // COLLECTION_BYTES
    cuts = heads[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))] if len(heads) else heads
    for members_ in np.split(shared, cuts[1:]) if len(cuts) else []:
        ends = np.cumsum(lengths[members_])
        offsets = np.concatenate([[0], ends])
        at = np.arange(ends[-1]) + np.repeat(bucket.offsets[members_] - offsets[:-1], lengths[members_])
        with tempfile.TemporaryDirectory() as folder:
            hit[at] = repeated(bucket.data[at], offsets, size, folder)
    found = np.flatnonzero(hit)
    row = np.searchsorted(bucket.offsets, found, "right") - 1
    whole = bucket.copies > 1  # every window of these repeats
    keep = (found + size <= bucket.offsets[1:][row]) & ~whole[row]  # only where a whole window starts
    found, row = found[keep], row[keep]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (row[1:] != row[:-1])])[: len(found)])
    twins = np.flatnonzero(whole)
    which = np.concatenate([row[begins], twins])
    a = np.concatenate([found[begins] - bucket.offsets[row[begins]], np.zeros(len(twins), np.int64)])
    b = a + np.concatenate([np.diff(np.append(begins, len(found))), lengths[twins] - size + 1])
    order = np.lexsort((a, which))
    return which[order], a[order], b[order], np.zeros(len(order), np.int64)


def spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """_id, _h, spans of bytes to remove, for rows as ``_superkmers.rows_of`` gives them."""
    marks, plan = sk.marked(docs, sk.Plan(size, MINIMISER, False), lambda b: twice(b, size), "substrings")
    return sk.covered(docs, plan, marks, later_only=False)


def remove_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    rows = sk.rows_of(docs, id_col, text_col)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            out = []
            for text, (x, y) in zip(b.column(1).to_pylist(), sk.spans_of(b), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                gone = sk.mask(len(raw), x, y)
                out.append((len(raw), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.string())], names)

    return sk.cut(rows, spans(rows, size), run, id_col, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the characters that it removes in part."""
    first = ~_text.CONTINUATION[raw]
    char = np.cumsum(first) - 1
    kept = np.bincount(char, ~gone, int(char[-1]) + 1 if len(char) else 0) > 0
    return gone & ~kept[char] if len(char) else gone


def clean_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated substrings cut from the text, at whole characters; all other columns stay."""
    key, text_hash, gone = (unused(docs, name) for name in ("_id", "_h", "_spans"))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(sk.NO_ID)), text_hash: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    found = spans(sk.rows_of(docs, id_col, text_col), size).select(F.col("_id").alias(key), F.col("_h").alias(text_hash), F.col("spans").alias(gone))

    @F.pandas_udf("string")
    def cut(texts, a, b):
        out = []
        for text, x, y in zip(texts, a, b, strict=True):
            if text is None or x is None or not len(x):
                out.append(text)
                continue
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            removed = whole_characters(raw, sk.mask(len(raw), np.asarray(x), np.asarray(y)))
            out.append(raw[~removed].tobytes().decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    joined = keyed.join(found, [key, text_hash], "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(f"{gone}.a"), F.col(f"{gone}.b"))).select(docs.columns)
