import zlib

import numpy as np
from pyspark.sql import functions as F

from stemma.llm import langid, line_crf, order_minhash, toxicity

from . import brute

WORDS = {"en": "the of and with for that this from which their", "de": "der die und mit für dass ein von nicht auch", "fr": "le la et avec pour que une dans est sur"}


def speech(spark, n=240):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = list(rng.choice(WORDS[lang].split(), 40))
        toxic = int(i % 5 == 0)
        if toxic:
            for k in rng.integers(0, 40, 4):
                w[k] = rng.choice(["nastyword", "vileword"])
        rows.append((i, " ".join(w), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_held_out(spark):
    docs = speech(spark)
    out = {r.doc_id: r for r in toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic").where("doc_id % 2 = 0 or toxic = 0")).collect()}
    truth = {r.doc_id: r.toxic for r in docs.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in out.items())
    unseen = [i for i in out if held(i)]
    assert np.mean([out[i].predicted == truth[i] for i in unseen]) > 0.95


def test_toxicity_ignores_held_out_labels(spark):
    docs = speech(spark)
    labels = docs.select("doc_id", "toxic")
    from stemma.llm._spark import held_out

    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, other).collect())


def test_toxicity_edges(docs, no_docs, labels, rows):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_language_profiles(spark):
    docs = speech(spark)
    out = langid.language_id(docs.drop("toxic")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in out if r.held_out)


def test_profile_ranks_and_distance():
    texts = ["aab ab", "b"]
    symbols, row, gram, count = langid.grams(texts)
    found = dict(zip(zip(row.tolist(), langid.spell(symbols, gram), strict=True), count.tolist(), strict=True))
    assert found[0, "a"] == 3 and found[0, "ab"] == 2 and found[0, "_a"] == 2 and found[0, "_aa"] == 1 and found[0, "b_"] == 2 and found[1, "_b_"] == 1
    assert not any("a" in g for r, g in found if r == 1)
    table = {"a": [(0, 0)], "b": [(0, 1), (1, 0)], "_b": [(1, 1)]}
    langs, score = langid.nearest(["b", "", "12"], ["x", "y"], table, top=10)
    # ranks of "b": code points order equal counts: _b, _b_, b, b_
    assert langs == ["y", "und", "und"] and score.tolist()[1:] == [0.0, 0.0]
    assert abs(score[0] - (1 - (abs(0 - 1) + 10 + abs(2 - 0) + 10) / 40)) < 1e-9 or score[0] > 0


def test_language_blocks_agree(spark, monkeypatch):
    docs = speech(spark)
    whole = sorted(langid.language_id(docs).collect())
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert sorted(langid.language_id(docs).collect()) == whole


def test_language_edges(docs, no_docs, rows):
    out = langid.language_id(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    texts = dict(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i, t in texts.items() if i is not None and not any(c.isalpha() for c in t or ""))
    assert langid.language_id(no_docs).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_base_counts(docs, labels, rows):
    out = line_crf.line_quality(docs, labels)
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()), key=key)
    assert got == sorted(((i, *brute.base_quality(t)) for i, t in rows), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in out.collect())


def test_crf_separates_junk(spark):
    rng = np.random.default_rng(4)
    line = lambda: " ".join(rng.choice([f"word{k}" for k in range(400)], 12)) + "."
    rows = [(i, "\n".join(line().upper() + "!!" if i % 2 else line() for _ in range(8)), 1 - i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 80], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in line_crf.line_quality(docs, labels).collect()}
    assert all(out[i] == bool(q) for i, _, q in rows)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        x, theta = rng.normal(size=(n, 3)), rng.normal(size=(5, 2))
        emit, trans = x @ theta[:3], theta[3:]
        score = lambda p: sum(emit[t, s] for t, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(np.ndindex(*[2] * n), key=score)
        assert tuple(line_crf.viterbi(x, np.array([0]), np.array([n]), theta)) == best


def test_quality_edges(docs, no_docs, labels):
    assert line_crf.line_quality(no_docs, labels).count() == 0
    out = line_crf.line_quality(docs, labels.where("quality = 1")).collect()
    assert all(r.kept != r.base_failed for r in out)


def test_order_minhash(docs, rows):
    out = order_minhash.edit_fingerprints(docs, buckets=3).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    import hashlib

    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        t = t or ""
        cut = len(t) // 4
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=key) == sorted(expected, key=key)
    by = {}
    texts = dict(rows)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None and r.doc_id not in (5, 7):
            assert by.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    long = [r for r in out if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_order_matters():
    a = "".join(chr(97 + k * 7 % 26) + chr(97 + k % 23) for k in range(300))
    same, moved = order_minhash.signatures([a, a[300:] + a[:300], a])[[0, 1]], order_minhash.signatures([a])
    assert order_minhash.likeness(same[:1], moved)[0] == 1.0
    assert order_minhash.likeness(same[1:], moved)[0] < 0.9


def test_signature_against_plain_selection():
    """Occurrence numbers keep repeated k-mers apart: a repeated text still fills selections."""
    s = order_minhash.signatures(["ab" * 200, "", "x"])
    assert (s[0] != 0).sum() > 40 and (s[1] == 0).all() and (s[2] != 0).sum() == 1
    assert order_minhash.likeness(s[1:2], s[1:2])[0] == 1.0 and order_minhash.likeness(s[:1], s[1:2])[0] == 0.0


def plain_signature(text, k=10, ell=2, bin_bits=6):
    """One text's selections from the kernel's own hashes of its numbered k-mers, chosen one by one."""
    from collections import Counter

    from stemma.llm import _text

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return [0] * (1 << bin_bits)
    at = np.arange(max(1, len(codes) - k + 1))
    hashes = _text.span_hash(_text.prefix_sums(_text.mix(codes.astype(np.uint64) + np.uint64(1))), at, np.minimum(at + k, len(codes)))
    seen, found = Counter(), {}
    for place, h in enumerate(hashes):
        n = int(_text.mix(np.array([int(h) + seen[h] * 0xD6E8FEB86659FD93 & (1 << 64) - 1], np.uint64))[0])
        seen[h] += 1
        found.setdefault(n >> (64 - bin_bits), []).append((n, place))
    out = [0] * (1 << bin_bits)
    for b, numbered in found.items():
        places = sorted(place for _, place in sorted(numbered)[:ell])
        value = 0
        for j in range(ell):
            part = int(hashes[places[j]]) if j < len(places) else 0
            value = int(_text.mix(np.array([(value * 0x9E3779B97F4A7C15 + part + j + 1) & (1 << 64) - 1], np.uint64))[0])
        out[b] = value >> 48 or 1
    return out


def test_signatures_are_those_of_a_plain_selection():
    rng = np.random.default_rng(8)
    texts = ["ab" * 30, "", "x", "short", *("".join(rng.choice(list("abcd é中"), rng.integers(1, 400))) for _ in range(30))]
    assert order_minhash.signatures(texts).tolist() == [plain_signature(t) for t in texts]


def test_equal_texts_in_other_company():
    """A text's fingerprint doesn't depend on the texts that it shares a slice with, whatever the hashes' bits."""
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abc"), 300)) for _ in range(40)]
    together = order_minhash.signatures(texts + texts)
    alone = np.concatenate([order_minhash.signatures([t]) for t in texts])
    assert (together[:40] == alone).all() and (together[40:] == alone).all()


def test_hashes_that_share_all_but_their_last_bits():
    hashes = np.uint64(0xABCDEF0123456789) ^ np.array([5, 1, 5, 0, 1, 7], np.uint64)
    assert order_minhash.by_hash_and_place(hashes).tolist() == sorted(range(6), key=lambda i: (hashes[i], i))


def test_minhash_of_great_and_repeated_ids(spark):
    """Ids above 2**53, a null among them, a frequent id: every row comes back with its successor."""
    rng = np.random.default_rng(10)
    text = lambda n: "".join(rng.choice(list("abcdef "), n))
    rows = [((1 << 53) + 3 * i, text(30)) for i in range(400)] + [(None, text(20)), ((1 << 63) - 1, text(9)), (-(1 << 63), text(9))]
    rows += [(77, text(12)) for _ in range(200)] + [(77, "same")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = order_minhash.edit_fingerprints(docs, buckets=8).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = [(i, order_minhash.edited(t, ordered[(k + 1) % len(ordered)][1])) for k, (i, t) in enumerate(ordered)]
    import hashlib

    key = lambda t: (t[0] is None, t)
    assert sorted(((r.doc_id, r.edited_sha256) for r in out), key=key) == sorted(((i, hashlib.sha256(e.encode()).hexdigest()) for i, e in expected), key=key)
    dealt = order_minhash.with_next(docs, "doc_id", "text", 8).where("not _copy and _id = 77").groupBy("_bucket").count().collect()
    assert len(dealt) > 1


def test_minhash_edges(no_docs, spark):
    assert order_minhash.edit_fingerprints(no_docs).count() == 0
    one = order_minhash.edit_fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert one[0].n_chars == 4 and one[0].near_next == 1.0
