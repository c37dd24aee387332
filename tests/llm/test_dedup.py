import numpy as np
import pytest

from stemma.llm import _superkmers, near_dup, substring_dedup, suffix_dedup

from . import brute


def test_near_duplicates(docs, rows, same):
    same(near_dup.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(rows))


def test_near_duplicates_of_large_children(docs, rows, same, monkeypatch):
    """Children above the limit branch again and end in blocks; nothing is lost."""
    monkeypatch.setattr(near_dup, "SMALL_DOCS", 3)
    monkeypatch.setattr(near_dup, "MAX_LEVEL", 3)
    many = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i}") for i in range(12)]
    spark = docs.sparkSession
    same(near_dup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(many))


def test_substring_dedup(docs, rows, same):
    same(substring_dedup.remove_repeats(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.window_repeats(rows))


def test_substring_dedup_with_hot_minimisers(docs, rows, same, monkeypatch):
    """Frequent m-grams rank last; the result is the same whatever the order."""
    monkeypatch.setattr(_superkmers, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(_superkmers, "FLUSH_BYTES", 20000)
    same(substring_dedup.remove_repeats(docs, size=20), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.window_repeats(rows, 20))


def test_suffix_dedup(docs, rows, same):
    same(suffix_dedup.remove_substrings(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.substring_repeats(rows))


def test_suffix_dedup_in_small_collections(docs, rows, same, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", 2000)
    monkeypatch.setattr(_superkmers, "BUCKET_BYTES", 20000)
    same(suffix_dedup.remove_substrings(docs, size=60), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.substring_repeats(rows, 60))


@pytest.mark.parametrize("seed", range(20))
def test_column_wise_construction(seed, tmp_path):
    """Transform and common prefixes equal those of sorted suffixes with ordered end marks."""
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(1, 4, rng.integers(1, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    bwt, lcp = suffix_dedup.collection(data, offsets, str(tmp_path))
    suffixes = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    suffixes.sort(key=lambda x: ([*(c + 1000 for c in x[0]), x[1]]))
    assert bwt.tolist() == [strings[i][k - 1] if k else 0 for _, i, k in suffixes]
    common = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        common.append(n)
    assert lcp.tolist() == common


def test_frequent_summary_bound():
    rng = np.random.default_rng(3)
    values = rng.zipf(1.5, 20000) % 1000
    held = None
    for part in np.array_split(values, 50):
        held = _superkmers.frequent(held, *np.unique(part.astype(np.uint64), return_counts=True), 40)
    found = dict(zip(held[0].tolist(), held[1].tolist(), strict=True))
    assert len(found) <= 40
    for key, count in zip(*np.unique(values, return_counts=True), strict=True):
        assert found.get(int(key), 0) <= count <= found.get(int(key), 0) + 20000 / 40 + 1


def test_empty_tables(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_substrings(no_docs).count() == 0
    assert suffix_dedup.clean_texts(no_docs).columns == no_docs.columns


def test_clean_texts_keeps_whole_characters(spark):
    shared = "é" * 150
    docs = spark.createDataFrame([(1, "a" + shared + "b"), (2, "cc" + shared + "d"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.clean_texts(docs).collect()} == {1: "ab", 2: "ccd", 3: None}
