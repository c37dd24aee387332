"""Hashes, sort keys, samples and columns in the cases that are easiest to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import _superkmers, _text, langid, line_crf, near_dup, packing, substring_dedup, suffix_dedup, toxicity

from . import brute


def arranged(n, a="a", b="b"):
    """Two words of 2**n letters that polynomial hashes modulo a power of two can't tell apart, whatever their base and codes."""
    return "".join((a, b)[k.bit_count() % 2] for k in range(1 << n)), "".join((b, a)[k.bit_count() % 2] for k in range(1 << n))


def test_arranged_words_have_their_own_hashes():
    data = np.frombuffer(" ".join([*arranged(10), *arranged(11), *arranged(12)]).encode(), np.uint8)
    words = _text.Words(data, np.array([0, len(data)]))
    for which in (0, 1):
        assert len(np.unique(words.hashes(which=which))) == len(words) == 6


def test_arranged_documents_are_told_apart(spark, same):
    one, other = arranged(11)
    rows = [(1, one), (2, other), (3, one), (4, " ".join([one] * 60)), (5, " ".join([other] * 60)), (6, " ".join(f"w{k} {one}" for k in range(40))), (7, " ".join(f"w{k} {other}" for k in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dup.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(rows))
    same(substring_dedup.remove_repeats(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.window_repeats(rows))
    short = [(i, t[:3000]) for i, t in rows]
    same(suffix_dedup.remove_substrings(spark.createDataFrame(short, "doc_id long, text string")), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.substring_repeats(short))


def test_minimisers_are_alike_in_every_slice():
    """Equal windows have equal minimisers whatever else is in their slice, even where orders tie on the bits compared."""
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 99, 3000).astype(np.uint8))
    plan = _superkmers.Plan(200, 48, False)

    def minimisers(before, after):
        data = np.frombuffer(before + text + after, np.uint8)
        row, begin, windows, anchor = _superkmers.Units(data, np.array([0, len(before), len(before) + 3000, len(data)]), plan).super_kmers(plan)
        at = row == 1
        return np.repeat(anchor[at], windows[at]).tolist()

    alone = minimisers(b"", b"")
    assert len(alone) == 2801 and minimisers(b"xyz" * 5, b"") == alone == minimisers(bytes(rng.integers(0, 256, 1 << 20).astype(np.uint8)), b"q" * 70_000)


def test_rows_sorted_by_all_bits():
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 5, 400))
    hashes = np.uint64(0xF0F0F0F0F0F00000) | rng.integers(0, 3, 400).astype(np.uint64)
    order = _text.by_row(rows, hashes)
    assert list(zip(rows[order], hashes[order], strict=True)) == sorted(zip(rows, hashes, strict=True))


def test_repeated_words_of_long_texts():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], n)) for n in (20_000, 50, 3, 5000)]
    texts += [" ".join(f"{k:x}" for k in range(60_000)), "a b a b a b", "x x x x"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lines = line_crf.Lines(data, offsets)
    for k, t in enumerate(texts):
        assert (lines.n_words[k], lines.word_chars[k], lines.n_symbols[k], lines.n_dup_lines[k], lines.n_repeat_words[k]) == brute.base_quality(t)


def test_chain_gradient_against_differences():
    rng = np.random.default_rng(6)
    length = np.array([3, 1, 5, 2])
    x, y, theta = rng.normal(size=(11, 3)), rng.integers(0, 2, 11), rng.normal(size=(5, 2))
    first = np.cumsum(length) - length

    def loglik(theta):
        total = 0.0
        for s, n in zip(first, length, strict=True):
            score = lambda p, s=s: sum(x[s + t] @ theta[:3, k] for t, k in enumerate(p)) + sum(theta[3 + a, b] for a, b in zip(p, p[1:], strict=False))
            total += score(y[s : s + n].tolist()) - math.log(sum(math.exp(score(p)) for p in np.ndindex(*[2] * n)))
        return total

    value, slope = line_crf.gradient(x, y, first, length, theta)
    assert abs(value - loglik(theta)) < 1e-9
    for at in np.ndindex(*theta.shape):
        up, down = theta.copy(), theta.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs(slope[at] - (loglik(up) - loglik(down)) / 2e-5) < 1e-6


def test_risk_gradient_of_positive_unlabelled_learning():
    """The step direction is the gradient of the non-negative risk, or away from its negative part where that is below zero."""
    rng = np.random.default_rng(7)
    loss = lambda z: np.logaddexp(0, -z)
    for prior, shift in ((0.2, 0.0), (0.9, 3.0)):
        p, u = rng.normal(size=6) + shift, rng.normal(size=9) - shift
        negative = loss(-u).mean() - prior * loss(-p).mean()
        risk, towards = toxicity.risk_gradient(p, u, prior)
        assert abs(risk - (prior * loss(p).mean() + max(0.0, negative))) < 1e-12
        objective = (lambda p, u: prior * loss(p).mean() + loss(-u).mean() - prior * loss(-p).mean()) if negative >= 0 else (lambda p, u: -(loss(-u).mean() - prior * loss(-p).mean()))  # noqa: B023
        both = np.concatenate([p, u])
        for k in range(15):
            up, down = both.copy(), both.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            assert abs(towards[k] - (objective(up[:6], up[6:]) - objective(down[:6], down[6:])) / 2e-6) < 1e-6


@pytest.mark.parametrize("fit", ["toxicity", "quality"])
def test_samples_are_bounded_and_in_a_set_order(spark, monkeypatch, fit):
    """One id on thousands of rows doesn't enlarge the sample, and the order of the rows doesn't change the model."""
    rows = [(1, f"nasty word {k % 3}\nline {k}") for k in range(3000)] + [(k, f"some clean text of number {k}\nand more") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    if fit == "toxicity":
        train = toxicity.train
        monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append((len(p), len(u))) or train(p, u, prior, epochs=1, least_steps=1))
        made = [toxicity.fit(d, spark.createDataFrame([(1,)], "doc_id long"), 0.2, max_positives=10, max_unlabelled=20) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
        assert seen == [(10, 20)] * 2
    else:
        train = line_crf.train
        monkeypatch.setattr(line_crf, "train", lambda x, y, first, length: seen.append(len(x)) or train(x, y, first, length, steps=3))
        labels = spark.createDataFrame([(k, int(k > 1)) for k in range(1, 60)], "doc_id long, quality int")
        made = [line_crf.fit(d, labels, max_docs=10) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
        assert seen[0] == seen[1] <= 2 * 10 * 2
    assert (made[0] == made[1]).all()


def test_out_of_place_distance_against_plain_ranks():
    """The nearest language's score by the definition: n-grams ranked by count, then by code points."""
    from collections import Counter

    texts = ["aab ab", "b", "bb abba ab", "c"]
    table = {"a": [(0, 0)], "b": [(0, 1), (1, 0)], "_b": [(1, 1)], "ab": [(0, 2)], "b_": [(1, 2), (0, 3)]}
    top = 10
    langs, score = langid.nearest(texts, ["x", "y"], table, top)
    for text, lang, got in zip(texts, langs, score, strict=True):
        n = Counter()
        for w in text.split():
            m = f"_{w}_"
            n.update(g for k in (1, 2, 3) for i in range(len(m) - k + 1) for g in [m[i : i + k]] if g.strip("_"))
        # shorter n-grams come first among equal counts, and the mark of an edge before all letters
        order = lambda g: [{"\0": -1, "_": 0}.get(c, ord(c)) for c in g.rjust(3, "\0")]
        ranked = sorted(n, key=lambda g: (-n[g], order(g)))[:top]  # noqa: B023
        distance = {}
        for k, name in enumerate(["x", "y"]):
            rank = {g: r for g, places in table.items() for j, r in places if j == k}
            distance[name] = sum(abs(rank[g] - i) if g in rank else top for i, g in enumerate(ranked))
        best = min(distance, key=lambda v: (distance[v], v))
        assert lang == best and abs(got - (1 - distance[best] / (top * len(ranked)))) < 1e-12


def test_stages_leave_clashing_columns_alone(spark, tmp_path, rows, labels):
    """Columns with the names that operators use themselves come through every stage unchanged."""
    clash = ["score", "lang_pred", "_text", "spans", "_spans", "_id", "_h", "_hash", "_toxicity", "_lang_pred", "_lang_score"]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, "xy"[k % 2], f"row {k}", None, *(f"{c} {k}" for c in clash)) for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for r in docs.collect():
            k = r.source.removeprefix("row ")
            assert all(r[c] == f"{c} {k}" for c in clash), name
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(300)}"
    rows = [(i, " ".join([word() for _ in range(60)] + ["nastyword"] * (i % 4 == 0) * 3), "x", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert np.mean([i in left for i in range(0, 600, 4)]) < 0.05 and np.mean([i in left for i in range(600) if i % 4]) > 0.95


def test_cut_repeats_against_brute_force(spark, tmp_path, docs, rows):
    """What the stage leaves of a text is what brute force leaves of it, at whole characters."""
    import hashlib
    from collections import Counter

    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = Counter((r.doc_id, None if r.text is None else hashlib.sha256(r.text.encode("utf-8", "surrogatepass")).hexdigest(), r.n_chars == (None if r.text is None else len(r.text))) for r in corpus_pipeline.cut_repeats(spark, table, "").collect())
    plain = [(i, t) for i, t in rows if t is None or t.isascii()]
    want = Counter((i, None if t is None else digest, True) for (i, t), (_, _, _, _, digest) in zip(rows, brute.substring_repeats(rows), strict=True) if t is None or t.isascii())
    assert len(plain) > 3 and all(got[k] == n for k, n in want.items()) and sum(got.values()) == len(rows)


def test_packing_of_null_and_repeated_ids(docs, rows):
    """Every row is packed once, equal ids and nulls too, and no sequence overflows."""
    from collections import Counter

    out = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, _ in rows)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
