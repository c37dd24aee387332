"""BPE encoding and decoding through a table of distinct words.

A word here is what the vocabulary's pre-tokenizer makes of a text (a run of letters, a digit, a run
of signs), lower-cased; only words that need the tokenizer's own normalizers stay whole.  Documents
are dealt to blocks of about ``BLOCK_BYTES``.  Each block sends its distinct words, packed in sorted
order, to the words' buckets; a bucket encodes each of its distinct words once and sends every block
the ids of the words it asked for, in the same order; there they go back to each word's place in its
text.  Blocks and buckets follow the bytes of the input, so a task holds one of either whatever the
input's size, and nothing goes through the driver but the vocabulary's fixed id-to-piece table, which
decoding joins to the ids in every task.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows are
encoded one by one, and dealt to blocks by their places, so that copies don't meet in one; an empty
table gives no rows; there are no ties; columns other than the id and text are ignored.  A text of any length is
encoded whole, one above 1 MB as a slice of its own.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, _words
from ._spark import prepare

BLOCK_BYTES = 24 << 20  # of texts in a block
BUCKET_BYTES = 48 << 20  # of texts for each bucket of words: words are about an eighth of that


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> list[bytes]:
    """The id-to-piece table, by id."""
    return _words.Encoder(path).vocabulary()


def asked_for(pieces: list[str], odd: list[str], buckets: int) -> list[list[str]]:
    """The distinct words of a block, in sorted order, by bucket."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for word in sorted({*pieces, *odd}):
        out[zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
    return out


def sent(words: list[str]) -> tuple[bytes, bytes]:
    """(words as lines, their digest); no word holds a line break."""
    lines = "\n".join(words).encode("utf-8", "surrogatepass")
    return lines, xxhash.xxh128_digest(lines)


def numbered(texts: pa.ChunkedArray) -> tuple[_words.Numbers, list[np.ndarray]]:
    """The distinct white-space separated words of some texts, and each text as numbers of them."""
    numbers = _words.Numbers()
    return numbers, [numbers.of(t.split()) for chunk in texts.chunks for t in _text.raw_texts(chunk)]


def requests(dealt: DataFrame, text_col: str, path: str, buckets: int) -> DataFrame:
    """_bucket, _block, words: every block's distinct words, one packed row for each bucket they belong to."""

    def run(group: pa.Table) -> pa.Table:
        numbers, _ = numbered(group[text_col])
        _, odd, parts = _words.encoder(path).split(list(numbers))
        distinct = set(parts)
        distinct.discard("\n")
        pack = zstandard.ZstdCompressor(level=3).compress
        rows = [(k, pack(sent(words)[0])) for k, words in enumerate(asked_for(distinct, odd, buckets)) if words]
        return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([group["_block"][0].as_py()] * len(rows), pa.int64()), _text.binary([w for _, w in rows])], ["_bucket", "_block", "words"])

    return dealt.groupBy("_block").applyInArrow(run, "_bucket long, _block long, words binary")


def answers(asked: DataFrame, path: str) -> DataFrame:
    """_block, _bucket, digest, sizes, ids: each bucket's distinct words encoded once, for every request in the order of its words."""

    def run(group: pa.Table) -> pa.Table:
        numbers, unpack = _words.Numbers(), zstandard.ZstdDecompressor().decompress
        lines = [unpack(w) for w in group["words"].to_pylist()]
        codes = [numbers.of(x.split(b"\n")) for x in lines]
        ids, sizes = _words.encoder(path).encode(list(numbers))
        pack = zstandard.ZstdCompressor(level=1).compress
        made = [_words.spread(ids, sizes, c) for c in codes]
        return pa.table(
            [
                group["_block"], group["_bucket"], _text.binary([xxhash.xxh128_digest(x) for x in lines]),
                _text.binary([pack(n.astype("<u4").tobytes()) for _, n in made]), _text.binary([pack(i.astype("<u4").tobytes()) for i, _ in made]),
            ], ["_block", "_bucket", "digest", "sizes", "ids"])

    return asked.groupBy("_bucket").applyInArrow(run, "_block long, _bucket long, digest binary, sizes binary, ids binary")


def word_ids(words: list[bytes], found: pa.Table, path: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of a block's words out of the buckets' answers.

    Should a recomputed block hold other words than it asked for, those of such a bucket are encoded here.
    """
    if not words:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    is_odd, odd, parts = _words.encoder(path).split(words)
    distinct = set(parts)
    distinct.discard("\n")
    by = {r["_bucket"]: r for r in found.to_pylist()}
    unpack = zstandard.ZstdDecompressor().decompress
    place: dict[str, int] = {}
    ids, sizes = [], []
    for k, asked in enumerate(asked_for(distinct, odd, buckets)):
        if not asked:
            continue
        lines, digest = sent(asked)
        place.update(zip(asked, range(len(place), len(place) + len(asked)), strict=True))
        if k in by and by[k]["digest"] == digest:
            sizes.append(np.frombuffer(unpack(by[k]["sizes"]), "<u4").astype(np.int64))
            ids.append(np.frombuffer(unpack(by[k]["ids"]), "<u4"))
        else:
            more, n = _words.encoder(path).encode(lines.split(b"\n"))
            ids.append(more)
            sizes.append(n)
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    of = lambda names: _words.spread(ids, sizes, np.fromiter(map(place.__getitem__, names), np.int64, len(names)))
    return _words.put_together(is_odd, odd, parts, of, of)


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """n_tokens and the SHA-256 digests of ids and decoded text of every whole text."""
    spark = prepare(docs.sparkSession)
    path = path or _words.default_path()
    docs = docs.select(id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    # both uses of the dealt documents read one shuffle
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(blocks, "_block")
    found = answers(requests(dealt, text_col, path, buckets), path)
    pieces = spark.sparkContext.broadcast(vocabulary(path))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, codes = numbered(left[text_col])
        ids, sizes = word_ids(list(numbers), right, path, buckets)
        del numbers
        flat, cuts = ids.tolist(), np.append(0, np.cumsum(sizes)).tolist()
        piece, spelled = pieces.value, [b"%d" % i for i in range(len(pieces.value))]
        as_ids = [b" ".join(map(spelled.__getitem__, flat[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        as_text = [b" ".join(map(piece.__getitem__, flat[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        rows = []
        for code in codes:
            at = code[sizes[code] > 0].tolist()
            rows.append((int(sizes[code].sum()), *(hashlib.sha256(b" ".join(map(x.__getitem__, at))).hexdigest() for x in (as_ids, as_text))))
        return pa.Table.from_arrays([left[id_col], pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names)

    schema = docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return dealt.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, schema)
