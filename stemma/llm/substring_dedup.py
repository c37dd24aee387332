"""Removal of repeated word windows by super-k-mer partitioning.

Windows of ``size`` consecutive words that share a minimiser travel as one packed string to its
bucket.  There sorting brings equal windows together and gives each the least id it starts in; a
document loses every word that is covered by a window with a smaller id.

Defined results: a null text has no words; a text with fewer words than a window keeps them all; of
rows with equal ids none precedes the other; a null id is greater than any other and comes back
null.  Repeated rows give repeated results.  An empty table gives no rows; other columns are ignored, whatever their names.
A text above 1 MB is a slice of its own, which takes about 60 bytes of memory a letter; all of its windows count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _superkmers as sk
from . import _text

WINDOW, MINIMISER = 50, 3


def first_starts(bucket: sk.Bucket, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose least id is below the greatest id that their super-k-mer occurs in."""
    words = _text.Words(bucket.data, bucket.offsets)
    begin, rows = words.windows(size)
    hashes = [_text.span_hash(_text.prefix_sums(words.hashes(which=which)), begin, begin + size) for which in (0, 1)]
    order = np.argsort(hashes[0], kind="stable")
    if len(order):  # windows that agree in one hash and not in the other are sorted by both
        clash = (hashes[0][order[1:]] == hashes[0][order[:-1]]) & (hashes[1][order[1:]] != hashes[1][order[:-1]])
        order = np.lexsort(hashes[::-1]) if clash.any() else order
    new = np.concatenate([[True], (hashes[0][order[1:]] != hashes[0][order[:-1]]) | (hashes[1][order[1:]] != hashes[1][order[:-1]])])[: len(order)]
    at = np.flatnonzero(new)
    least = np.zeros(len(order), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(bucket.least[rows[order]], at), np.diff(np.append(at, len(order))))
    hit = np.flatnonzero(least < bucket.greatest[rows])
    begins = np.concatenate([[True], (np.diff(hit) != 1) | (rows[hit[1:]] != rows[hit[:-1]]) | (least[hit[1:]] != least[hit[:-1]])])[: len(hit)]
    start = np.flatnonzero(begins)
    a = hit[start] - np.searchsorted(rows, rows[hit[start]])
    return rows[hit[start]], a, a + np.diff(np.append(start, len(hit))), least[hit[start]]


def _kept(batch: pa.RecordBatch):
    for text, (a, b) in zip(batch.column(1).to_pylist(), sk.spans_of(batch), strict=True):
        words = text.encode("utf-8", "surrogatepass").split()
        gone = sk.mask(len(words), a, b)
        yield words, gone


def spans(docs: DataFrame, size: int = WINDOW) -> tuple[DataFrame, sk.Plan]:
    """_id, _h, spans of words to remove, for rows as ``_superkmers.rows_of`` gives them."""
    marks, plan = sk.marked(docs, sk.Plan(size, MINIMISER, True), lambda b: first_starts(b, size), "windows")
    return sk.covered(docs, plan, marks, later_only=True), plan


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, texts: bool = False) -> DataFrame:
    """id, n_words, n_removed and the digest of the kept words (or, with ``texts``, the kept text itself)."""
    rows = sk.rows_of(docs, id_col, text_col)
    found, _ = spans(rows, size)

    def run(batches):
        for b in batches:
            out = [(len(w), int(gone.sum()), b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])) for w, gone in _kept(b)]
            last = pa.array([o[2].decode("utf-8", "surrogatepass") if texts else hashlib.sha256(o[2]).hexdigest() for o in out], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), last], [id_col, "n_words", "n_removed", "kept"])

    made = sk.cut(rows, found, run, id_col, f"{id_col} long, n_words long, n_removed long, kept string")
    return made.withColumnRenamed("kept", "text" if texts else "kept_sha256")
