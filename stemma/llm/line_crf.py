"""Quality rules with a line labeller: a linear-chain CRF marks each line as content or boilerplate.

Every line has a few features of its own (length, symbols, capitals, table bars, repetition, ...);
the CRF adds what neighbouring labels say about each other.  It is trained here by maximum
likelihood, on a bounded sample of labelled documents whose quality label stands for all of their
lines, and Viterbi decoding labels the lines of every whole text.  A document is kept if at least
``min_share`` of its word characters are in content lines and the base rules pass.

Defined results: a null or empty text has no words, so it fails the base rules; lines without a word
take no label; without labelled documents of both kinds every line is content, so that the base
rules alone decide; repeated rows are judged one by one; an empty table gives no rows; columns other than those named
are ignored or, by ``keep``, passed on.  A text above 1 MB is a slice of its own, which takes about 40 bytes of memory a letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare, stored, unused, whole_rows

CONTENT, BOILERPLATE = 0, 1
#: Fixed by the base rules: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
N_FEATURES = 12
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), range(65, 91))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])
_DIGIT = np.isin(np.arange(256), range(48, 58))


class Lines:
    """The lines with a word of a slice: row, size and features of each, and the base counts of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        words = _text.Words(data, offsets)
        hashes, rows = words.hashes(), words.rows()
        before = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        chars, upper, letter, digit = (before(m[data]) for m in (~_text.CONTINUATION, _UPPER, _LETTER, _DIGIT))
        symbol, newline, bang, bar = before(_SYMBOL[data]), before(data == 10), before(data == 33), before(data == 124)

        self.n_words = words.counts.astype(np.int64)
        size = chars[words.ends] - chars[words.starts]
        self.word_chars = np.bincount(rows, size, n).astype(np.int64)
        self.n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]
        self.n_repeat_words = self._repeats(words, hashes, n)

        line = newline[words.starts] + rows  # a row's end also ends its last line
        new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(words) else np.zeros(0, int)
        last = np.concatenate([new[1:], [len(words)]])[: len(new)]
        self.rows, count = rows[new], last - new
        # a line's bytes, outer white space included, decide whether it repeats
        breaks = np.flatnonzero(data == 10)
        left = np.maximum(np.concatenate([[-1], breaks])[newline[words.starts[new]]] + 1, offsets[self.rows]) if len(new) else new
        right = np.minimum(np.append(breaks, len(data))[newline[words.starts[new]]], offsets[self.rows + 1]) if len(new) else new
        same = _text.apart_hashes(data, left, right)
        order = np.lexsort((same, self.rows))
        again = np.zeros(len(new), bool)
        if len(new):
            again[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (self.rows[order[1:]] == self.rows[order[:-1]])
        self.n_dup_lines = np.bincount(self.rows, again, n).astype(np.int64)

        line_of_word = np.repeat(np.arange(len(new)), count)
        keys = np.lexsort((hashes, line_of_word))
        distinct = np.ones(len(keys), bool)
        distinct[1:] = (hashes[keys[1:]] != hashes[keys[:-1]]) | (line_of_word[keys[1:]] != line_of_word[keys[:-1]])
        n_distinct = np.bincount(line_of_word[keys], distinct, len(new))
        self.chars = np.bincount(line_of_word, size, len(new))
        span = lambda sums: (sums[right] - sums[left]).astype(float)
        letters, all_chars = np.maximum(span(letter), 1), np.maximum(self.chars, 1)
        self.features = np.stack(
            [
                np.ones(len(new)), np.log1p(count) / 4, count < 4, span(symbol) / all_chars, span(upper) / letters, span(upper) / letters > 0.5,
                span(digit) / all_chars, np.minimum(span(bang) / np.maximum(count, 1), 1), np.minimum(span(bar) / np.maximum(count, 1), 1), again,
                1 - n_distinct / np.maximum(count, 1), np.minimum(self.chars / np.maximum(count, 1), 20) / 10,
            ], 1)

    @staticmethod
    def _repeats(words: _text.Words, hashes: np.ndarray, n: int) -> np.ndarray:
        begin, rows = words.windows(3)
        if not len(begin):
            return np.zeros(n, np.int64)
        grams = _text.span_hash(_text.prefix_sums(hashes), begin, begin + 3)
        where = _text.by_row(rows, grams)
        twin = (grams[where[1:]] == grams[where[:-1]]) & (rows[where[1:]] == rows[where[:-1]])
        found = np.zeros(len(words) + 3, np.int64)
        hit = begin[where[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]]
        np.add.at(found, hit, 1)
        np.add.at(found, hit + 3, -1)
        return np.bincount(words.rows(), np.cumsum(found)[: len(words)] > 0, n).astype(np.int64)


def sequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of each run of equal rows."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return first, np.diff(np.concatenate([first, [len(rows)]]))


def gradient(x: np.ndarray, y: np.ndarray, first: np.ndarray, length: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels and its gradient, over all chains at once: one step per line number."""
    by = np.argsort(-length, kind="stable")
    first, length = first[by], length[by]
    longest = int(length[0])
    open_at = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    begin = np.concatenate([[0], np.cumsum(open_at)])
    at = np.concatenate([first[:k] + t for t, k in enumerate(open_at)])  # lines by number, the longest chains first
    X, Y = x[at], y[at]
    emit, trans = X @ theta[:-2], theta[-2:]
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[: begin[1]] = emit[: begin[1]]
    log_z = np.empty(len(length))
    expected, gold = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, longest):
        k, now, then = open_at[t], slice(begin[t], begin[t + 1]), slice(begin[t - 1], begin[t - 1] + open_at[t])
        alpha[now] = emit[now] + np.logaddexp(alpha[then][:, :1] + trans[0], alpha[then][:, 1:] + trans[1])
        np.add.at(gold, (len(gold) - 2 + Y[then], Y[now]), 1)
        done = slice(k, open_at[t - 1])
        log_z[done] = np.logaddexp(*alpha[begin[t - 1] + k : begin[t]].T)
    log_z[: open_at[-1]] = np.logaddexp(*alpha[begin[-2] :].T)
    for t in range(longest - 1, 0, -1):
        k, now, then = open_at[t], slice(begin[t], begin[t + 1]), slice(begin[t - 1], begin[t - 1] + open_at[t])
        after = emit[now] + beta[now]
        beta[then] = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
        expected[-2:] += np.exp(alpha[then][:, :, None] + trans + after[:, None] - log_z[:k, None, None]).sum(0)
    node = np.exp(alpha + beta - np.concatenate([log_z[:k] for k in open_at])[:, None])
    expected[:-2] = X.T @ node
    gold[:-2] = X.T @ np.stack([Y == 0, Y == 1], 1).astype(float)
    return float((gold * theta).sum() - log_z.sum()), gold - expected


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray, length: np.ndarray, *, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """CRF weights: (features, 2) emissions, then (2, 2) transitions, by gradient ascent of the likelihood."""
    theta = np.zeros((x.shape[1] + 2, 2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = gradient(x, y, first, length, theta)[1] / len(x) - decay * theta
        m += 0.1 * (slope - m)
        v += 0.01 * (slope**2 - v)
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def viterbi(x: np.ndarray, first: np.ndarray, length: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The likeliest labels of every line, over all sequences at once: one step per line number."""
    emit, trans = x @ theta[:-2], theta[-2:]
    back = np.zeros((len(x), 2), np.int8)
    labels = np.zeros(len(x), np.int8)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    best = emit[first].copy()
    open_at = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for t in range(1, len(open_at)):
        k, here = open_at[t], first[: open_at[t]] + t
        zero = best[:k, :1] + trans[0] >= best[:k, 1:] + trans[1]
        back[here] = np.where(zero, 0, 1)
        best[:k] = emit[here] + np.where(zero, best[:k, :1] + trans[0], best[:k, 1:] + trans[1])
    state = best.argmax(1).astype(np.int8)
    for t in range(len(open_at) - 1, -1, -1):
        k = open_at[t]
        here = first[:k] + t
        labels[here] = state[:k]
        state[:k] = back[here, state[:k]]
    return labels


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 3000, max_lines: int = 400_000) -> np.ndarray | None:
    """Trains on at most ``max_docs`` labelled texts of each kind, each a chain of all its lines.

    The texts with the least hashes of id and text are taken, each once and whole; where those of one kind have more than
    ``max_lines`` lines in all, fewer are taken, and one of more lines than that is passed over.  So at most
    2 * max_lines lines of 48 bytes come to the driver, and in a set order.  None unless both kinds are there.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("_quality"))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_text"))
    rank = F.xxhash64("_id", "_h").alias("_rank")
    labelled = keyed.select("_id", "_h").distinct().join(known, "_id").select(rank, "_id", "_h", "_quality")
    first = lambda kind: labelled.where(F.col("_quality") == kind).orderBy("_rank", "_id", "_h").limit(max_docs)
    wanted = first(0).unionAll(first(1))

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(4)):
                lines = Lines(data, offsets)
                chosen, n_lines = [b""] * (hi - lo), np.zeros(hi - lo, np.int64)
                for at, n in zip(*sequences(lines.rows), strict=True):
                    chosen[lines.rows[at]] = lines.features[at : at + n].astype(np.float32).tobytes()
                    n_lines[lines.rows[at]] = n
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:4]), pa.array(n_lines), _text.binary(chosen)], ["_rank", "_id", "_h", "_quality", "_n", "_x"])

    # `wanted` holds at most 2 * max_docs rows; equal rows of `docs` become one again
    joined = keyed.join(F.broadcast(wanted), ["_id", "_h"]).select("_rank", "_id", "_h", "_quality", "_text")
    made = joined.mapInArrow(run, joined.drop("_text").schema.add("_n", "long").add("_x", "binary")).where("_n > 0")
    made = stored(made.dropDuplicates(["_id", "_h"]), "quality_sample")
    sample = sorted(map(tuple, whole_rows(made, "_quality", ["_rank", "_id", "_h"], "_n", max_lines).collect()))
    chains = [(np.frombuffer(raw, np.float32).reshape(-1, N_FEATURES), BOILERPLATE if quality == 0 else CONTENT) for _, _, _, quality, _, raw in sample]
    if len({k for _, k in chains}) < 2:
        return None
    length = np.array([len(p) for p, _ in chains])
    return train(np.concatenate([p for p, _ in chains]).astype(float), np.repeat([k for _, k in chains], length), np.cumsum(length) - length, length)


def judge(docs: DataFrame, theta: np.ndarray | None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_share: float = 0.5) -> DataFrame:
    """The base counts, content_share and the verdict of every row, beside the columns ``keep``."""
    prepare(docs.sparkSession)
    text = unused(docs.select(*keep), "_text")
    docs = docs.select(*keep, F.col(text_col).alias(text))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(len(keep))):
                lines = Lines(data, offsets)
                label = np.zeros(len(lines.rows), np.int8) if theta is None else viterbi(lines.features, *sequences(lines.rows), theta)
                content = np.bincount(lines.rows, lines.chars * (label == CONTENT), hi - lo)
                share = content / np.maximum(lines.word_chars, 1)
                failed = (lines.n_words < 50) | (100 * lines.n_repeat_words > 50 * lines.n_words)
                values = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), *(pa.array(v.astype(np.int64)) for v in values), pa.array(share), pa.array(failed), pa.array(~failed & (share >= min_share))], [*keep, *made])

    schema = docs.drop(text).schema
    for name in made[:5]:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema.add("content_share", "double").add("base_failed", "boolean").add("kept", "boolean"))


def line_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on ``labels`` (id, quality) and judges every row of ``docs``."""
    return judge(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col=text_col, keep=(id_col,))
