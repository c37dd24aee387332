import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stemma.llm import _words, bpe, packing, url_filter
from stemma.llm.queries import OP6_SQL, RULES, listed_urls


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(_words.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 20_000, "bucket_bytes": 50_000}])
def test_bpe_equals_the_library(docs, rows, tokenizer, same, sizes):
    """In one block and bucket, and in many."""
    out = bpe.encode_decode(docs, **sizes)
    same(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [(i, *digests(tokenizer, t)) for i, t in rows])


def test_bpe_of_long_words(spark, tokenizer, same):
    """Words of more than 65,535 tokens, and of 100,000 characters."""
    unspaced = "".join(chr(0x4E00 + int(k)) for k in np.random.default_rng(3).integers(0, 5000, 70_000))
    texts = [(1, unspaced), (2, f"a {unspaced} b"), (3, "plain words"), (4, None), (5, "ab" * 50_000), (6, "x1!" * 33_334)]
    expected = [(i, *digests(tokenizer, t)) for i, t in texts]
    assert expected[0][1] > 65_535
    same(bpe.encode_decode(spark.createDataFrame(texts, "doc_id long, text string")), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)


def test_bpe_of_many_distinct_words(spark, tokenizer, same):
    """300,000 distinct words over several blocks and buckets."""
    texts = [(i, " ".join(f"w{chr(97 + k % 26)}{k:x}" for k in range(i * 30_000, (i + 1) * 30_000))) for i in range(10)]
    out = bpe.encode_decode(spark.createDataFrame(texts, "doc_id long, text string"), block_bytes=500_000, bucket_bytes=500_000)
    same(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [(i, *digests(tokenizer, t)) for i, t in texts])


def test_bpe_of_a_block_that_was_dealt_anew(tokenizer):
    """Answers to other words than a block holds aren't used."""
    import pyarrow as pa

    none = pa.table({"_bucket": [0], "_block": [0], "digest": [b"x"], "sizes": [b""], "ids": [b""]})
    words = ["Alpha,", "beta", "Σ中"]
    ids, sizes = bpe.word_ids([w.encode() for w in words], none, _words.default_path(), 2)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [g.tolist() for g in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_bpe_reads_one_shuffle_of_the_documents(docs, spark, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    out = bpe.encode_decode(spark.read.parquet(f"{tmp_path}/documents"))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_bpe_edges(no_docs):
    assert bpe.encode_decode(no_docs).count() == 0


def test_packing(docs, rows, tokenizer):
    out = packing.pack_documents(docs.where("doc_id is not null and doc_id not in (5, 7)")).collect()
    texts = {i: t for i, t in rows if i is not None and i not in (5, 7)}
    by, bins = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, parts in by.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048)) and [r.piece for r in parts] == list(range(len(parts)))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
        assert sum(r.length for r in parts) == len(ids)
    for parts in bins.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist() and sum(r.length for r in parts) <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(by):
    lengths = np.sort(np.random.default_rng(1).integers(1, 70, 500))[::-1]
    where, offset = packing.best_fit(lengths, (100, 5, 6000), (1.0, 0.1, 0.1), by)
    for b in range(where.max() + 1):
        part = lengths[where == b]
        assert part.sum() <= 100 and len(part) <= 5 and (part**2).sum() <= 6000
        assert sorted(offset[where == b]) == np.concatenate([[0], np.cumsum(part[np.argsort(offset[where == b])])[:-1]]).tolist()


def test_packing_edges(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?q#f", "http://a.net/es/x", "http://net/es/", "ftp://x.example.com/en", "http://spam-farm.b.org/a//", "http://spam-farm.b.org/a", "http://q.org?x/en/", "x://y://z.net/fr/1", "http://notexample.com/en/1", "http://spam-farm.b.org/a"]


def test_url_rules_and_list(spark):
    import duckdb

    pages = spark.createDataFrame([(k if k else None, u) for k, u in enumerate(URLS)], "page_id long, url string")
    out = url_filter.filter_urls(pages, listed_urls(pages), RULES)
    pdf = pages.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pdf)
    expected = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict, listed FROM ({OP6_SQL})").fetchall()))
    found = sorted(str((None if r.page_id is None else r.page_id, r.host, r.path, r.rule, r.verdict, r.listed)) for r in out.collect())
    assert [e.replace("nan", "None").replace(".0,", ",") for e in expected] == found


def test_bloom_has_no_false_negatives_and_few_hits(spark, monkeypatch):
    keys = spark.range(2000).select(F.concat(F.lit("k.org/"), "id").alias("canonical"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://k.org/"), "id").alias("url"))
    for limit in (url_filter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        out = url_filter.filter_urls(pages, keys, [])
        assert {r.page_id for r in out.where("listed").collect()} == set(range(2000)) and out.count() == 4000


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, listed_urls(none), RULES).count() == 0


def test_words_equal_the_library(tokenizer):
    words = ["alpha", "Beta's", "gamma!", "x1y22", "d\u00e9j\u00e0", "\u0130stanbul", "a\u0301", "\u4e2d\u6587", "<|endoftext|>", "a<|endoftext|>b", "\x1c\x00", "\xa0", "\x85z", "don't", "\u00bd\u00b2", "..--", "\U0001f642"]
    ids, sizes = _words.encoder(_words.default_path()).encode([w.encode() for w in words])
    assert [g.tolist() for g in np.split(ids, np.cumsum(sizes)[:-1])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("tight", [{"max_docs": 3}, {"max_attention": 2500}])
def test_packing_keeps_tight_capacities(spark, tight):
    lengths = [int(v) for v in np.random.default_rng(5).integers(1, 45, 200)]
    most = {}
    for name, options in (("loose", {}), ("tight", tight)):
        items, bins = spark.createDataFrame([(k, 0, v) for k, v in enumerate(lengths)], "doc_id long, piece int, length int"), {}
        for r in packing.pack(items, max_tokens=100, **options).collect():
            bins.setdefault(r.sequence_id, []).append(r.length)
        assert sorted(v for b in bins.values() for v in b) == sorted(lengths) and max(map(sum, bins.values())) <= 100
        most[name] = max(map(len, bins.values())) if "max_docs" in tight else max(sum(v * v for v in b) for b in bins.values())
    (limit,) = tight.values()
    assert most["tight"] <= limit < most["loose"]
