"""Runs, one-bit search and collocations against brute force, and in the cases that break things."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import _text, collocations, one_bit_search, periodic_runs

WORDS = re.compile("[^\x20\x09-\x0d]+")


def runs_of(w, min_length=6, min_exponent=4):
    """(start, length, period) of all runs, by trying every period."""
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            n = e + q - s
            if e > s and n >= max(min_length, min_exponent * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(i, text, rewrite=True):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if rewrite and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found, gone = runs_of(w), set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    return (i, len(found), *top, 1000 * top[1] // top[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_digests(docs, rows, same):
    short = [(i, t) for i, t in rows if len(t or "") < 6_000]
    found = periodic_runs.run_digests(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 6_000), rewrite=F.crc32(F.col("doc_id").cast("string")))
    same(found, RUN_COLUMNS, [run_row(i, t) for i, t in short])


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_short_alphabets(seed):
    """Many runs, ties and nested periods; runs of two periods and more as well."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n, p = int(rng.integers(0, 60)), int(rng.integers(1, 8))
            t = rng.integers(0, rng.integers(1, 4), n)
            if n > 3 * p and rng.random() < 0.5:
                t[2:] = np.resize(t[2 : 2 + p], n - 2)
            texts.append(t.tolist())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes = _text.mix(np.array(sum(texts, []), np.uint64) + np.uint64(seed + 1))
        for length, exponent in ((6, 4), (2, 2), (3, 3)):
            got = list(zip(*(v.tolist() for v in periodic_runs.runs(codes, offsets, length, exponent)), strict=True))
            assert got == [(a + s, a + s + n, q) for t, a in zip(texts, offsets.tolist(), strict=False) for s, n, q in runs_of(t, length, exponent)]


def test_lyndon_words_under_both_orders():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(0, 3, rng.integers(1, 25)).tolist()
        ext = periodic_runs.Extensions(np.array(t, np.uint64) * np.uint64(1 << 40))
        end, begin = np.full(len(t), len(t)), np.zeros(len(t), int)
        for flip in (False, True):
            v = [-x for x in t] if flip else t
            lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
            want = [max(n for n in range(1, len(v) - i + 1) if lyndon(v[i : i + n])) for i in range(len(v))]
            assert periodic_runs.lyndon_lengths(ext, begin, end, flip).tolist() == want


def test_runs_of_very_long_texts(spark):
    """20 MB in one text: a million equal words before another one, and words without a run."""
    rng = np.random.default_rng(1)
    plain = " ".join(f"{v:x}" for v in rng.integers(0, 1 << 30, 1_500_000).tolist())
    rows = [(1, "spam " * 1_000_000 + "end"), (2, plain), (3, "x y " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in periodic_runs.run_digests(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 1_000_000, 1) and got[1].collapsed_sha256 == hashlib.sha256(b"spam end").hexdigest()
    assert got[2].n_runs == 0 and got[2].collapsed_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert got[3].n_runs == 0 or got[3].exponent_milli >= 4000


def test_run_spans_and_collapsed_texts(docs, no_docs, spark):
    texts = [(1, "a b c a b c a b c a b c d"), (1, "a b c a b c a b c a b c d"), (None, "z z z z z z z"), (2, None), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.run_spans(df).collect()), key=str) == sorted([(1, 0, 12, 3)] * 2 + [(None, 0, 7, 1)], key=str)
    assert sorted((r.text or "-" for r in periodic_runs.collapsed_texts(df).collect())) == ["-", "-", "a b c d", "a b c d", "z"]
    assert periodic_runs.run_digests(no_docs).count() == 0 and periodic_runs.run_spans(no_docs).count() == 0
    assert periodic_runs.collapsed_texts(no_docs).columns == no_docs.columns


def nearest_of(vectors, every, k):
    ok = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8 and any(v)]
    out = set()
    for i, q in ok:
        if i is not None and i % every == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(q, v, strict=True)), j is None, j if j is not None else 0) for j, v in ok if j != i)
            out |= {(i, r + 1, None if none else j) for r, (s, none, j) in enumerate(scores[:k])}
    return out


def test_one_bit_search(spark):
    """Odd vectors, repeated ids, ties, few candidates; the exact answer at this size."""
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (201, vectors[3][1]), (None, vectors[5][1]), (202, None), (203, [0.0] * 8), (204, [1.0, None, *[0.0] * 6]), (206, [float("nan")] * 8), (208, [float("inf")] * 8), (210, [1.0] * 5), (212, [])]
    vectors = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in vectors], "vec_id long, embedding array<float>, _id int, score string").repartition(4)
    got = one_bit_search.nearest(df, every=4, k=7, epsilon=6.0).collect()
    assert len(got) == len({(r.query_id, r.rank) for r in got})
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == nearest_of(vectors, 4, 7)
    few = one_bit_search.nearest(df.where("vec_id < 4"), every=2, k=7).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(i, r) for i in (0, 2) for r in (1, 2, 3)]
    assert one_bit_search.nearest(df.where("false")).count() == 0 and one_bit_search.nearest(df.where("vec_id = 202")).count() == 0


def test_one_bit_recall_and_tiles(spark, monkeypatch):
    """Recall of 0.99 at least over several tiles, and few rows reranked once a threshold is known."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(one_bit_search, "TILE_BYTES", 4 * 64 * 1500)
    monkeypatch.setattr(one_bit_search, "MOST_QUERIES", 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in one_bit_search.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = np.arange(0, 6000, 20)
    scores = x[queries].astype(float) @ x.astype(float).T
    scores[np.arange(len(queries)), queries] = -9
    want = np.argsort(-scores, axis=1)[:, :20]
    assert sorted(got) == queries.tolist()
    assert np.mean([len(got[q] & set(w.tolist())) / 20 for q, w in zip(queries.tolist(), want, strict=True)]) >= 0.99
    codes, scalars = one_bit_search.encode(x.astype(float), one_bit_search.BITS)
    *_, reranked = one_bit_search.tile(x[queries].astype(float), queries, x.astype(float), np.arange(6000), codes, scalars, 20, one_bit_search.EPSILON)
    assert reranked < 0.15 * len(queries) * 6000


def test_estimates_and_bounds():
    """Estimates are right on average, and bounds fail about as often as three spreads say."""
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    codes, scalars = one_bit_search.encode(x, 256)
    estimate, upper = one_bit_search.Planes(q, 256).bounds(codes, scalars, 3.0)
    error = (estimate - q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    assert abs(error.mean()) < 2e-3 and (upper < q @ x.T).mean() < 4e-3


def phrases_of(rows, support, longest, first):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    out = []
    frequent = {k: a for k, a in counts.items() if a >= support}
    for (lang, w), a in frequent.items():
        if len(w) > 1:
            cuts = [(1000 * a * words[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = any(g >= a and len(v) > len(w) and any(v[j : j + len(w)] == w for j in range(len(v) - len(w) + 1)) for (other, v), g in frequent.items() if other == lang)
            if not inside:
                out.append((lang, -score, -a, " ".join(w).encode(), frequent[lang, w[:k]], frequent[lang, w[k:]], words[lang]))
    ranks, made = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= first:
            made.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return made


def talk(n=400, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "new", "york", "TIMES", "é", "ßa", "of", "and", "a", "x-1", "中文", "_"]
    weights = np.array([5, 3, 3, 2, 1, 1, 4, 4, 6, 1, 1, 1.0])
    rows = []
    for k in range(n):
        w = rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum())
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for x in w)
        rows.append((["en", "de", None, "und"][k % 4], text if k % 9 else "new york times of the new york times"))
    return rows + [(None, None), ("en", ""), ("fr", None), ("de", " ... ,,, ")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("shard", "support"), [(1 << 30, 20), (3000, 20), (200, 7)])
def test_collocations(spark, same, monkeypatch, shard, support):
    """One shard, many, and so many that their support falls to 1."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rows = talk()
    df = spark.createDataFrame([(k, *r, 1, "w") for k, r in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(5)
    same(collocations.collocations(df, support=support, first=30), COLUMNS, phrases_of(rows, support, 5, 30))


def test_collocations_of_nothing_and_of_one_long_text(spark, no_docs, same):
    assert collocations.collocations(no_docs).count() == 0
    rows = [("en", "a b c, " * 200_000 + "a B"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    same(collocations.collocations(df), COLUMNS, phrases_of_repeat())


def phrases_of_repeat():
    """Of 200,000 times "a b c" in pieces of their own, and "a b" once more: "a b" occurs once more than "a b c", so both stay, with one score."""
    n = 600_002
    return [("en", 1, "a b", 200_001, 200_001, 200_001, n, 1000 * n // 200_001), ("en", 2, "a b c", 200_000, 200_001, 200_000, n, 1000 * n // 200_001)]
