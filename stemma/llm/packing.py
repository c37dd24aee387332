"""Best-fit packing of tokenized documents by vector capacities.

A sequence has room for tokens, documents and attention cost (the sum of squared lengths).  Within a
group of pieces, taken from longest to shortest, each piece goes to the open sequence that it fits
under every capacity and that has the least weighted norm of what remains, or, as an option, the
greatest weighted dot product of piece and room; where none fits, a new one opens.  Pieces are dealt
to groups of about ``group_pieces`` by a hash, so groups are bounded and independent; each leaves a
few sequences part filled, out of thousands.

Defined results: a null or empty text is the end token alone; equal pieces are taken by id and piece
number; repeated rows are packed one by one; an empty table gives no sequence.  Texts of any length are encoded and cut into pieces whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, _words
from ._spark import prepare, stored

MAX_TOKENS = 2048
GATHER_BYTES = 32 << 20  # of texts whose distinct words a task encodes together


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every document's tokens, cut only beyond ``max_tokens``.

    A task gathers about ``GATHER_BYTES`` of texts, encodes their distinct words once and forgets them again.
    """
    prepare(docs.sparkSession)
    path = path or _words.default_path()
    end, step = np.array([end_id], "<u4").tobytes(), 4 * max_tokens
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for held in _text.gathered(batches, GATHER_BYTES):
            numbers = _words.Numbers()
            codes = [[numbers.of(text.split()) for text in _text.raw_texts(b.column(1))] for b in held]
            ids, sizes = _words.encoder(path).encode(list(numbers))
            for b, of_batch in zip(held, codes, strict=True):
                rows = []
                tokens, n = _words.spread(ids, sizes, np.concatenate(of_batch))
                raw, ends = tokens.tobytes(), np.append(0, 4 * np.cumsum(n))[np.cumsum([0, *map(len, of_batch)])].tolist()
                for i, s, e in zip(b.column(0).to_pylist(), ends, ends[1:], strict=False):
                    of_doc = raw[s:e] + end
                    rows += [(i, k, k * max_tokens, min(step, len(of_doc) - at) // 4, zlib.crc32(of_doc[at : at + step])) for k, at in enumerate(range(0, len(of_doc), step))]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names)

    docs = docs.select(id_col, text_col)
    schema = docs.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each of ``lengths``, which are in falling order."""
    cap, w = np.array(capacity, float), np.array(weights, float)
    room = np.zeros((3, max(64, len(lengths))))  # shares of each capacity that open sequences have left
    names = np.zeros(room.shape[1], np.int64)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled = np.zeros(len(lengths), np.int64)
    n_open = n_bins = 0
    least = lengths[-1] / cap[0] if len(lengths) else 0
    slack = 1e-12
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length]) / cap
        have = room[:, :n_open]
        fits = np.flatnonzero((have[0] >= need[0] - slack) & (have[1] >= need[1] - slack) & (have[2] >= need[2] - slack))
        if len(fits):
            left = have[:, fits]
            score = w @ (left - need[:, None]) ** 2 if by == "norm" else -((w * need) @ left)
            k = fits[score.argmin()]
        else:
            k, n_open = n_open, n_open + 1
            room[:, k], names[k] = 1.0, n_bins
            n_bins += 1
        b = names[k]
        where[i], offset[i] = b, filled[b]
        filled[b] += length
        room[:, k] -= need
        if room[0, k] < least - slack or room[1, k] < 1 / cap[1] - slack:  # nothing that is left fits
            n_open -= 1
            room[:, k], names[k] = room[:, n_open], names[n_open]
    return where, offset


def pack(items: DataFrame, *, id_col: str = "doc_id", max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm", group_pieces: int = 24_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...).

    Pieces that fill a sequence get one of their own without being grouped.  ``max_attention``
    bounds the sum of squared lengths; its default, ``max_tokens`` squared, leaves all of it to tokens.
    """
    capacity = (max_tokens, max_docs, max_attention or max_tokens**2)
    part = items.where(F.col("length") < max_tokens)
    groups = max(1, -(-part.count() // group_pieces))
    dealt = part.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        where, offset = best_fit(group["length"].to_numpy(), capacity, weights, by)
        number = (group["_group"].to_numpy() << 32) | where
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("_group").applyInArrow(run, items.schema.add("sequence_id", "long").add("offset", "long"))
    full = items.where(F.col("length") >= max_tokens).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """Tokenizes, cuts and packs every document; the pieces' table, without their tokens, is stored once."""
    items = stored(pieces(docs, id_col=id_col, text_col=text_col, path=path, max_tokens=max_tokens), "pieces")
    return pack(items, id_col=id_col, max_tokens=max_tokens, **options)
