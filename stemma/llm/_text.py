"""Vectorised text kernels over Arrow buffers, shared by the operators of this subpackage.

Everything here works on a bounded slice of a record batch: the UTF-8 bytes of some texts, one
after another, with the offsets at which each text begins.  Words are maximal runs of bytes other
than space and 0x09-0x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE[LOWER]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64; kept per process."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_R, _R_INV)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of 64-bit codes; ``span_hash`` turns any two of them into a span's hash."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [starts, ends) that depend on their contents alone."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


@functools.lru_cache(maxsize=4)
def _multipliers(n: int, which: int) -> np.ndarray:
    """The first ``n`` of an endless series of unrelated odd numbers; ``which`` picks one of several such series."""
    return mix(np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15 * (which + 1) & (1 << 64) - 1)) | np.uint64(1)


def apart_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of nonempty spans that don't overlap and come in order.

    Every place in a span has a multiplier of its own (multilinear hashing), so that, unlike with powers of one
    base, no arrangement of bytes collides whatever the multipliers are; hashes of another ``which`` are unrelated.
    """
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # so that temporary arrays stay small
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        out[first:end] = _apart_hashes(data[starts[first] : ends[end - 1]], starts[first:end] - starts[first], ends[first:end] - starts[first], which)
        first = end
    return out


def _apart_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    longest = int((ends - starts).max())
    place = np.zeros(len(data), np.int64)
    place[starts] = np.diff(starts, prepend=0)
    place = np.minimum(np.arange(len(data)) - np.cumsum(place), longest - 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _multipliers(1 << (longest - 1).bit_length(), which)[place], out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a text column into (first row, end row, bytes, offsets) of about ``limit`` bytes.

    A null text counts as empty; a text longer than ``limit`` forms a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Groups of consecutive nonempty batches, each of about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def raw_texts(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    for _, _, data, offsets in slices(texts):
        raw, at = data.tobytes(), offsets.tolist()
        yield from (raw[a:b] for a, b in zip(at, at[1:], strict=False))


class Words:
    """The words of a slice: byte spans, the row each is in, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        return apart_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends, which)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, rows) of every window of ``size`` consecutive words inside one row."""
        n = np.maximum(self.counts - size + 1, 0)
        rows = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        return np.arange(n.sum()) - begin[rows] + self.first[:-1][rows], rows


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def by_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices in the order of ``rows``, and of all 64 bits of ``hashes`` within a row."""
    order = np.argsort(hashes)
    small = rows.astype(np.uint16) if len(rows) and rows[-1] < 1 << 16 else rows  # a stable sort of 16 bits is a radix sort
    return order[np.argsort(small[order], kind="stable")]


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
