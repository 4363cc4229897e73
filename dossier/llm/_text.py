"""Vectorised text primitives shared by the corpus operators.

Documents arrive as Arrow batches.  Their UTF-8 bytes lie back to back in one buffer, so words,
word hashes, n-gram hashes and sliding minima are computed with numpy over bounded pieces of that
buffer and never word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Freed Arrow buffers go back to the system: idle Python workers keep little.
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: A random 64-bit code for each byte value (fixed seed, so every worker and every retry agree).
BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of text taken at once; bounds the temporary arrays to a few tens of MB.
PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, 1 << 16) + (1 << 18)
        out = []
        for base in (_BASE, _INV):
            p = np.empty(size, U64)
            p[0] = 1
            done, mult = 1, base
            while done < size:
                k = min(done, size - done)
                p[done : done + k] = p[:k] * U64(mult)
                done += k
                mult = mult * mult & 0xFFFFFFFFFFFFFFFF
            out.append(p)
        _pow.update(n=size, p=out[0], i=out[1])
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads a 64-bit state over all its bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums of code[i] * BASE**i modulo 2**64."""
    p, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * p[: len(codes)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the code strings [start, end), equal for equal strings wherever they stand."""
    _, inv = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n codes, by start."""
    m = max(0, len(sums) - n)
    _, inv = _powers(len(sums))
    return mix((sums[n : n + m] - sums[:m]) * inv[:m])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offs: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each (one longer row stands alone)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (len(offs) values)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~separators[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(BYTE_CODE[buf]), starts, ends) if len(starts) else np.zeros(0, U64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by start, in log2(w) passes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if span < w else x[:n]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, range after range."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def binary_column(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose values lie back to back in `data`; lengths in bytes."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


class Members:
    """Membership in a sorted set of hashes: a bitmap turns most values away before the binary search."""

    def __init__(self, values: np.ndarray):
        self.values, self.shift = values, U64(64 - 20)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[values >> self.shift] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[x >> self.shift])
        return at[self.values[np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)] == x[at]]


def planes(x: np.ndarray, width: int = 5) -> bytes:
    """Non-negative integers as byte planes: the upper ones are zeros, which compress to nothing."""
    return np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def whole(raw: bytes, width: int = 5) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.int64).ravel()
