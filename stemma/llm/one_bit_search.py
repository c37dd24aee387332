"""Nearest vectors by inner product over randomly rotated one-bit codes.

Every vector is turned by random rotations, and of each coordinate only its sign is kept.  With c the unit
code turned back, o the unit vector and s = <c, o>, the ratio <c, q> / s estimates <o, q>; its error is the
part of c that is orthogonal to o, of length r = sqrt(|c|^2 - s^2), met by a direction that the random
rotations make arbitrary, so its spread is r / s / sqrt(dim - 1).  The packed signs, the norm, s and r are
the index.  A query's turned coordinates are quantised to four bit planes, and <c, q> comes from
populations of (code and plane).  Estimates plus ``epsilon`` spreads bound the inner product from above:
vectors whose bound reaches the k-th best exact value so far are reranked on the original components.

The index has every row.  Queries and rows meet in tiles of bounded size, one task group each, whose best
k are merged by query; nothing is broadcast or collected.  That is all queries against all rows, so work grows
as their product; a tile exchanges its vectors and codes alone, and tiles grow with the table up to 32 MB of vectors.

Defined results: a vector that is null, zero, of another length than the commonest one (the shortest of
those), or holds null or non-finite components takes no part, neither as a query nor as a candidate.  A row with a null
id can be found but isn't a query.  Rows that share a query's id are its own and aren't found by it; equal
query rows are searched once, different vectors of one id one by one (their results come under the same
``query_id``).  Repeated candidates each take a rank.  Ties go to the smaller id, null last.  Fewer candidates than
k are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare, stored

BITS, PLANES, EPSILON = 512, 4, 3.0
TILE_BYTES, CHUNK, MOST_QUERIES = 32 << 20, 2048, 2048
NO_ID = (1 << 63) - 1


@functools.lru_cache(maxsize=4)
def rotations(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """dim x bits: random rotations side by side, scaled so that lengths are kept."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return (np.concatenate(turns, 1)[:, :bits] * np.sqrt(dim / bits)).astype(np.float64)


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (rows x bits / 64 words) and, a row, norm, s and r."""
    turn = rotations(vectors.shape[1], bits)
    norm = np.sqrt((vectors**2).sum(1))
    unit = vectors / norm[:, None]
    signs = unit @ turn >= 0
    back = (np.where(signs, 1.0, -1.0) / np.sqrt(bits)) @ turn.T
    s = (back * unit).sum(1)
    r = np.sqrt(np.maximum((back**2).sum(1) - s**2, 0))
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64), np.stack([norm, s, r], 1)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> tuple[DataFrame, int]:
    """id, vector, code and correction scalars of every vector that takes part, and their length."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector"))
    length = F.size("_vector").alias("n")
    found = rows.where(F.col("_vector").isNotNull() & (F.size("_vector") > 0)).groupBy(length).count().orderBy(F.desc("count"), "n").first()
    dim = found["n"] if found else 0
    bits = -(-bits // 64) * 64

    def run(batches):
        for b in batches:
            column = b.column(1)
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
            with np.errstate(invalid="ignore"):
                good = np.isfinite(x).all(1) & (x != 0).any(1)
            norm = np.sqrt((np.where(good[:, None], x, 1) ** 2).sum(1))
            good &= np.isfinite(norm) & (norm > 0)
            if good.any():
                codes, scalars = encode(x[good], bits)
                kept = b.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*kept.columns, _text.binary([c.tobytes() for c in codes]), *(pa.array(scalars[:, k]) for k in range(3))], [*b.schema.names, "_code", "_norm", "_s", "_r"])

    whole = rows.where(F.size("_vector") == dim) if dim else rows.where("false")
    schema = whole.select("*").schema.add("_code", "binary").add("_norm", "double").add("_s", "double").add("_r", "double")
    return whole.mapInArrow(run, schema), dim


class Planes:
    """Queries ready to be estimated: their turned coordinates in bit planes."""

    def __init__(self, queries: np.ndarray, bits: int):
        turned = queries @ rotations(queries.shape[1], bits)
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(levels >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
        self.sum = self.low * bits + self.step * levels.sum(1)
        self.norm = np.sqrt((queries**2).sum(1))
        self.bits, self.dim = bits, queries.shape[1]

    def bounds(self, codes: np.ndarray, scalars: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of all queries with some rows, and upper bounds."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        met = np.zeros((len(self.low), len(codes)), np.uint16)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                met += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint16) << np.uint16(p)
        norm, s, r = scalars.T
        inner = 2 * (self.low[:, None] * ones + self.step[:, None] * met) - self.sum[:, None]
        estimate = inner * (norm / s / np.sqrt(self.bits))
        # the rounding of each coordinate is uniform, its share of the inner product a sum of that many
        rounding = (self.step / np.sqrt(12))[:, None] * (norm / s)
        spread = self.norm[:, None] * (norm * r / s / np.sqrt(max(self.dim - 1, 1)))
        return estimate, estimate + epsilon * np.sqrt(spread**2 + rounding**2) + 1e-9 * np.abs(estimate)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component on."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k best rows of a tile, best first, and how many pairs were reranked."""
    planes = Planes(queries, codes.shape[1] * 64)
    best_q, best_r, best_s, reranked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    least = np.full(len(queries), -np.inf)

    def merge(q, r):
        nonlocal best_q, best_r, best_s, reranked
        reranked += len(q)
        q, r, s = np.concatenate([best_q, q]), np.concatenate([best_r, r]), np.concatenate([best_s, products(queries[q], rows[r])])
        order = np.lexsort((ids[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, np.arange(len(queries) + 1))
        held = np.arange(len(q)) - first[q] < k
        full = np.diff(first) >= k
        least[full] = s[first[:-1][full] + k - 1]
        best_q, best_r, best_s = q[held], r[held], s[held]

    for lo in range(0, len(rows), CHUNK):
        hi = min(len(rows), lo + CHUNK)
        estimate, upper = planes.bounds(codes[lo:hi], scalars[lo:hi], epsilon)
        other = query_ids[:, None] != ids[None, lo:hi]
        if not np.isfinite(least).all() and hi - lo > k + 1:  # a first threshold from the best estimates
            top = np.argpartition(np.where(other, -estimate, np.inf), k, axis=1)[:, :k]
            chosen = np.zeros(estimate.shape, bool)
            np.put_along_axis(chosen, top, True, 1)
            chosen &= other
            q, r = np.nonzero(chosen)
            merge(q, r + lo)
            other &= ~chosen
        q, r = np.nonzero(other & (upper >= least[:, None]))
        merge(q, r + lo)
    return best_q, best_r, best_s, reranked


def search(found: DataFrame, dim: int, is_query: Column, *, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of an index for each of its rows that ``is_query`` (on ``_id``) holds for."""
    spark = found.sparkSession
    n, n_queries = found.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    per_rows = max(1, min(max(8192, n // 48), TILE_BYTES // (4 * max(dim, 1))))
    per_queries = min(max(512, n_queries // 4), MOST_QUERIES)
    row_blocks, query_blocks = -(-n // per_rows) or 1, -(-n_queries // per_queries) or 1
    place, upto = F.monotonically_increasing_id(), lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    rows = found.select((place % row_blocks).alias("_a"), F.explode(upto(query_blocks)).alias("_b"), "*")
    queries = found.where(is_query).select("_id", F.xxhash64("_id", "_vector").alias("_mark"), "_vector").dropDuplicates(["_id", "_mark"])
    queries = queries.select(F.pmod("_mark", F.lit(query_blocks)).alias("_b"), F.explode(upto(row_blocks)).alias("_a"), "*")

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:  # no query was dealt to this tile
            return pa.table({"query_id": pa.array([], pa.int64()), "_q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = left["_id"].fill_null(NO_ID).to_numpy(), right["_id"].to_numpy()
        codes = np.frombuffer(b"".join(left["_code"].to_pylist()), np.uint64).reshape(len(ids), -1)
        scalars = np.stack([left[c].to_numpy() for c in ("_norm", "_s", "_r")], 1)
        q, r, s, _ = tile(matrix(right["_vector"]), query_ids, matrix(left["_vector"]), ids, codes, scalars, k, epsilon)
        return pa.table({"query_id": query_ids[q], "_q": right["_mark"].to_numpy()[q], "vec_id": pa.array(ids[r], mask=ids[r] == NO_ID), "score": s})

    made = rows.groupBy("_a", "_b").cogroup(queries.groupBy("_a", "_b")).applyInArrow(run, "query_id long, _q long, vec_id long, score double")
    order = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, bits: int = BITS, epsilon: float = EPSILON) -> DataFrame:
    """Searches all ``vectors`` for the rows whose id is divisible by ``every``."""
    found, dim = index(vectors, id_col=id_col, vector_col=vector_col, bits=bits)
    return search(stored(found, "one_bit"), dim, F.col("_id") % every == 0, k=k, epsilon=epsilon)
