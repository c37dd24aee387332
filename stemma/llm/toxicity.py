"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any other documents the unlabelled set.  Linear
classifiers over hashed word presence minimise the non-negative PU risk

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]),      l(z) = log(1 + exp(-z)),

with the class prior ``pi``: where the second part turns negative, the step goes against its
gradient, which keeps a flexible model from driving it below zero.  Training sees a bounded sample
of rows (``max_positives`` and ``max_unlabelled``); scoring sees every whole text.

Defined results: a null or empty text has no features and scores the classifiers' bias; without a
single confirmed positive every document scores 0.0; repeated rows are scored one by one and alike; an empty table
gives no rows; columns of the input other than the id and text are ignored, whatever their names.  A text above 1 MB is
a slice of its own, which takes about 30 bytes of memory a letter; it is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import held_out, prepare, stored, unused, whole_rows

DIM_BITS = 18
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed lower-case letter runs of each row: (feature ids, how many each row has)."""
    letters = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = letters.copy(), letters.copy()
    begins[1:] &= ~letters[:-1] | edge[1:-1]
    ends[:-1] &= ~letters[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = _text.span_hash(_text.prefix_sums(_text.BYTE_CODE_LOWER[data]), starts, stops)
    rows = np.searchsorted(offsets, starts, "right") - 1
    keys = np.unique(rows.astype(np.uint64) << np.uint64(DIM_BITS) | hashes >> np.uint64(64 - DIM_BITS))
    counts = np.bincount((keys >> np.uint64(DIM_BITS)).astype(np.int64), minlength=len(offsets) - 1)
    return (keys & np.uint64((1 << DIM_BITS) - 1)).astype(np.uint32), counts


def margins(weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One model's linear score of each row; the last weight is the bias."""
    # every row is summed by itself, from its first feature on, so equal rows have equal sums
    return np.bincount(np.repeat(np.arange(len(counts)), counts), weights[ids], len(counts)) + weights[-1]


def log_ratios(positive: list[np.ndarray], unlabelled: list[np.ndarray], smooth: float = 20.0) -> np.ndarray:
    """Each feature's smoothed log ratio of its shares of the positive and of the unlabelled rows."""
    dim = 1 << DIM_BITS
    share = lambda docs: (np.bincount(np.concatenate(docs).astype(np.int64), minlength=dim) + smooth * len(docs) / (len(positive) + len(unlabelled))) / (len(docs) + smooth)
    return np.log(share(positive) / share(unlabelled))


def risk_gradient(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(the non-negative PU risk of margins of positives and of unlabelled rows, the direction to step away from, by margin).

    The direction is the risk's gradient, or, where its negative part is below zero, that part's gradient turned round.
    """
    loss = lambda z: np.logaddexp(0, -z)
    says = 1 / (1 + np.exp(-np.clip(np.concatenate([p, u]), -30, 30)))
    negative = loss(-u).mean() - prior * loss(-p).mean()
    # d loss(z) = sigmoid(z) - 1, d loss(-z) = sigmoid(z)
    sign = 1 if negative >= 0 else -1
    of_p = -sign * prior * says[: len(p)] / len(p) + (prior * (says[: len(p)] - 1) / len(p) if sign > 0 else 0)
    return prior * loss(p).mean() + max(0.0, negative), np.concatenate([of_p, sign * says[len(p) :] / len(u)])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, models: int = 3, epochs: int = 10, least_steps: int = 300, batch: int = 512, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights (models, dim + 1) that minimise the non-negative PU risk by Adam over mini-batches.

    A feature counts as much as its log ratio between positive and unlabelled rows, so that the many
    words that say nothing add little; the ratios are folded into the weights returned.
    """
    dim = 1 << DIM_BITS
    scale = np.append(log_ratios(positive, unlabelled), 1.0)
    out = np.zeros((models, dim + 1))
    for m in range(models):
        rng = np.random.default_rng(seed + m)
        w, first, second, step = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1), 0
        w[dim] = np.log(prior / (1 - prior))
        steps = max(1, len(unlabelled) // batch)
        for _ in range(max(epochs, least_steps // steps)):
            u_order, p_order = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
            for u_part, p_part in zip(np.array_split(u_order, steps), np.array_split(p_order, steps), strict=True):
                if not len(p_part):
                    p_part = p_order[:1]
                docs = [positive[i] for i in p_part] + [unlabelled[i] for i in u_part]
                counts = np.array([len(d) for d in docs])
                ids = np.concatenate(docs).astype(np.int64)
                z = margins(w * scale, ids, counts)
                _, towards = risk_gradient(z[: len(p_part)], z[len(p_part) :], prior)
                gradient = np.bincount(ids, np.repeat(towards, counts), dim + 1) * scale
                gradient[dim] = towards.sum()
                gradient[:dim] += decay * w[:dim]
                step += 1
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient**2 - second)
                w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w = w * scale
        w[dim] -= threshold(_all_margins(w, positive), _all_margins(w, unlabelled), prior)
        out[m] = w
    return out


def _all_margins(w: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    return np.array([w[d].sum() for d in docs]) + w[-1]


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin at which the non-negative PU estimate of the 0-1 risk is least; the median of equals."""
    grid = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 2001)))
    grid = (grid[1:] + grid[:-1]) / 2 if len(grid) > 1 else grid
    above = lambda z: 1 - np.searchsorted(np.sort(z), grid, "right") / len(z)
    caught = above(positive)
    risk = prior * (1 - caught) + np.maximum(0, above(unlabelled) - prior * caught)
    return float(np.median(grid[risk <= risk.min() + 1e-12]))


def fit(docs: DataFrame, toxic_ids: DataFrame, prior: float, *, id_col: str = "doc_id", text_col: str = "text", max_positives: int = 8000, max_unlabelled: int = 16000, max_features: int = 12_000_000) -> np.ndarray | None:
    """Trains on at most ``max_positives`` texts of ``toxic_ids`` and ``max_unlabelled`` texts of ``docs``.

    The texts with the smallest hashes of their ids and contents are taken, each once and whole, so the sample is the
    same each time; only their feature ids come to the driver, 4 bytes each.  Where those of one kind are more than
    ``max_features`` in all, fewer texts are taken.  None if no positive has a row.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_text")).where("_id is not null")
    ids = keyed.select("_id", "_h").distinct()
    first = lambda rows, n, role: rows.select(F.lit(role).alias("_role"), F.xxhash64("_id", "_h", F.lit(role)).alias("_rank"), "_id", "_h").orderBy("_rank", "_id", "_h").limit(n)
    known = toxic_ids.select(F.col(id_col).alias("_id")).distinct()
    wanted = first(ids.join(known, "_id", "left_semi"), max_positives, 1).unionAll(first(ids, max_unlabelled, 2))
    names = ["_role", "_rank", "_id", "_h", "_n", "_ids"]

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _text.slices(b.column(4)):
                found, counts = features(data, offsets)
                parts = np.split(found, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:4]), pa.array(counts.astype(np.int64)), _text.binary([p.tobytes() for p in parts])], names)

    # both sides of `wanted` are limits, so this broadcast never exceeds max_positives + max_unlabelled rows; equal rows of `docs` become one again
    joined = keyed.join(F.broadcast(wanted), ["_id", "_h"]).select("_role", "_rank", "_id", "_h", "_text")
    made = joined.mapInArrow(run, joined.drop("_text").schema.add("_n", "long").add("_ids", "binary"))
    made = stored(made.dropDuplicates(["_role", "_id", "_h"]), "toxicity_sample")
    sample = sorted(tuple(r) for r in whole_rows(made, "_role", ["_rank", "_id", "_h"], "_n", max_features).collect())
    positive, unlabelled = ([np.frombuffer(r[5], np.uint32) for r in sample if r[0] == role] for role in (1, 2))
    return train(positive, unlabelled, prior) if positive and unlabelled else None


def score(docs: DataFrame, weights: np.ndarray | None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Scores every row of ``docs`` in 0..1: the models' mean probability.  Keeps the columns ``keep``."""
    prepare(docs.sparkSession)
    if weights is None:
        return docs.select(*keep, F.lit(0.0).alias(out))
    text = unused(docs.select(*keep), "_text")
    docs = docs.select(*keep, F.col(text_col).alias(text))
    weights = weights.astype(np.float32)

    def run(batches):
        for b in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in _text.slices(b.column(len(keep))):
                ids, counts = features(data, offsets)
                z = np.stack([margins(w.astype(np.float64), ids, counts) for w in weights])
                scores.append((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(scores))], [*keep, out])

    schema = docs.drop(text).schema.add(out, "double")
    return docs.mapInArrow(run, schema)


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among the labelled ones; 0.1 where there are none."""
    mean = labels.select(F.avg(F.col("toxic").cast("double"))).first()[0]
    return min(0.9, max(0.01, mean)) if mean is not None else 0.1


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score and predicted of every row of ``docs``.

    ``labels`` has the id and ``toxic``; labels of held-out ids (crc32 of the id as text divisible
    by 5), and held-out texts, take no part in training.  An id labelled twice is toxic if any of
    its labels says so.  A null label is ignored.
    """
    seen = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col(id_col))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    weights = fit(docs.where(~held_out(F.col(id_col))), seen.where("toxic = 1"), class_prior(seen), id_col=id_col, text_col=text_col)
    scored = score(docs, weights, text_col=text_col, keep=(id_col,))
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
