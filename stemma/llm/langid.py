"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its ``top`` most frequent letter n-grams (1 to 3 letters, words
marked at both ends), counted over all training documents.  A document's profile is made alike, and
its out-of-place distance to a language is the sum over its n-grams of how many ranks the two
profiles differ, ``top`` for an n-gram that the language's profile lacks.  The nearest language wins.

Defined results: a null text and one without a letter are ``und`` with score 0.0, and so is every
text if there is nothing to learn from; equal distances go to the alphabetically first language;
equal counts rank by code points.  Repeated rows are judged one by one.  An empty table gives no rows and no
profiles; other columns are ignored or, by ``keep``, passed on.  A text above 1 MB is a slice of its own, which takes about 150 bytes
of memory a letter; it is ranked whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import held_out, prepare, unused

NONE, MARK = 0, 1  # codes below the letters': no symbol, and the edge of a word
#: Languages whose profiles meet the documents at once; more are compared in further blocks.
BLOCK = 256


@functools.cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row, gram, count) of the distinct n-grams of each text, in the order of row and gram.

    A gram's code is its symbols' indices into ``symbols`` in base ``len(symbols)``.
    """
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in lowered])
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), lengths)
    codes = np.where(is_letter()[codes], codes, MARK)
    keep = (codes != MARK) | (np.concatenate([[0], codes[:-1]]) != MARK)
    last = np.cumsum(lengths) - 1
    keep[last] = True  # every row ends in a mark, so that no gram spans two rows
    codes, rows = codes[keep], rows[keep]
    present = np.zeros(0x110000, bool)
    present[codes] = True
    present[[NONE, MARK]] = True
    symbols = np.flatnonzero(present)
    dense = np.zeros(0x110000, np.int64)
    dense[symbols] = np.arange(len(symbols))
    c, size = dense[codes], len(symbols)
    before = np.concatenate([[MARK], c[:-1]])
    after = np.concatenate([c[1:], [MARK]])
    letter, row = c != MARK, rows * size**3
    one = (row + c)[letter]
    two = np.concatenate([(row + before * size + c)[letter], (row + c * size + MARK)[letter & (after == MARK)]])
    three = (row + (before * size + c) * size + after)[letter]
    keys = np.sort(np.concatenate([one, two, three]))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    return symbols, keys[at] // size**3, keys[at] % size**3, counts


def spell(symbols: np.ndarray, gram: np.ndarray) -> list[str]:
    """Grams as strings, ``_`` for the edge of a word."""
    size = len(symbols)
    letters = ["", "_", *map(chr, symbols[2:].tolist())]
    return [letters[g // size**2] + letters[g // size % size] + letters[g % size] for g in gram.tolist()]


def strings(texts: pa.Array):
    for lo, hi, _, _ in _text.slices(texts):
        yield lo, hi, texts.slice(lo, hi - lo).fill_null("").to_pylist()


def profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = 300) -> DataFrame:
    """lang, gram, rank of each language's ``top`` most frequent n-grams over all rows of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches):
        sums: dict[tuple[str, str], int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "n"])
            sums.clear()
            return out

        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, texts in strings(b.column(1)):
                by = {v: i for i, v in enumerate(dict.fromkeys(langs[lo:hi]))}
                code = np.array([by[v] for v in langs[lo:hi]])
                symbols, row, gram, count = grams(texts)
                size = len(symbols) ** 3
                keys, where = np.unique(code[row] * size + gram, return_inverse=True)
                totals = np.bincount(where, count, len(keys)).astype(np.int64)
                names = list(by)
                for k, g, n in zip((keys // size).tolist(), spell(symbols, keys % size), totals.tolist(), strict=True):
                    sums[names[k], g] = sums.get((names[k], g), 0) + n
                if len(sums) > 200_000:
                    yield flush()
        yield flush()

    seen = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = seen.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < top).drop("n")


def nearest(texts: list[str], langs: list[str], table: dict[str, list[tuple[int, int]]], top: int) -> tuple[list[str], np.ndarray]:
    """The nearest language of each text and its score, 1 - distance / greatest distance."""
    symbols, row, gram, count = grams(texts)
    n, at = np.bincount(row, minlength=len(texts)), np.searchsorted(row, np.arange(len(texts)))
    most, index_bits = int(count.max(initial=1)), int(n.max(initial=1)).bit_length()
    bits = most.bit_length()
    key = (row << (bits + index_bits)) | ((most - count) << index_bits) | (np.arange(len(row)) - at[row])
    order = (np.sort(key) & ((1 << index_bits) - 1)) + at[row]
    rank = np.arange(len(row)) - at[row]
    order, rank, row = order[rank < top], rank[rank < top], row[rank < top]
    gram, used = gram[order], np.bincount(row, minlength=len(texts))

    size, dense = len(symbols), {chr(s): i for i, s in enumerate(symbols.tolist()) if i > MARK} | {"_": MARK}
    known, ranks = [], []
    for g, places in table.items():
        try:
            code = functools.reduce(lambda a, ch: a * size + dense[ch], g, 0)
        except KeyError:
            continue
        line = np.full(len(langs), -1)
        for k, r in places:
            line[k] = r
        known.append(code)
        ranks.append(line)
    distance = np.full((len(texts), len(langs)), 0.0)
    order = np.argsort(np.array(known, np.int64))
    codes, ranks = np.append(np.array(known, np.int64)[order], np.int64(2**62)), np.vstack([np.array(ranks, np.int64).reshape(-1, len(langs))[order], np.full((1, len(langs)), -1)])
    place = np.searchsorted(codes, gram)
    place[codes[place] != gram] = len(codes) - 1
    for k in range(len(langs)):
        r = ranks[place, k]
        distance[:, k] = np.bincount(row, np.where(r < 0, top, np.abs(r - rank)), len(texts))
    best = distance.argmin(1)
    share = 1 - distance[np.arange(len(texts)), best] / (top * np.maximum(used, 1))
    return [langs[k] if u else "und" for k, u in zip(best.tolist(), used.tolist(), strict=True)], np.where(used > 0, np.clip(share, 0, 1), 0.0)


def identify(docs: DataFrame, profile: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int = 300, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the nearest language and its score, named by ``out``, to the columns ``keep`` of every row of ``docs``.

    A block of at most ``BLOCK`` languages, so at most ``BLOCK * top`` grams, meets the documents at
    once; each further block takes over where it is nearer.
    """
    prepare(docs.sparkSession)
    names = [r.lang for r in profile.select("lang").distinct().orderBy("lang").toLocalIterator()]
    kept = docs.select(*keep)
    found = docs.select(*keep, F.lit("und").alias(out[0]), F.lit(0.0).alias(out[1]), F.col(text_col).alias(unused(kept, "_text")))
    for first in range(0, len(names), BLOCK):
        langs = names[first : first + BLOCK]
        table: dict[str, list[tuple[int, int]]] = {}
        for r in profile.where(F.col("lang").isin(langs)).collect():
            table.setdefault(r.gram, []).append((langs.index(r.lang), r.rank))
        found = _block(found, langs, table, top)
    return found.drop(found.columns[-1])


def _block(docs: DataFrame, langs: list[str], table: dict, top: int) -> DataFrame:
    """``docs`` ends in language, score and text."""

    def run(batches):
        for b in batches:
            pred, score = b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_numpy(zero_copy_only=False).copy()
            for lo, hi, texts in strings(b.column(b.num_columns - 1)):
                found, near = nearest(texts, langs, table, top)
                for i, (name, s) in enumerate(zip(found, near.tolist(), strict=True), lo):
                    if name != "und" and (pred[i] == "und" or s > score[i]):
                        pred[i], score[i] = name, s
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(pred, pa.string()), pa.array(score), b.column(b.num_columns - 1)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 300) -> DataFrame:
    """id, held_out, lang_pred and score of every row; learns from the rows that aren't held out."""
    learned = profiles(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col, top=top).cache()
    out = identify(docs, learned, text_col=text_col, keep=(id_col,), top=top)
    learned.unpersist()
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")
