"""Byte-level BPE encoding and decoding.

Each piece of a text (a match of the tokenizer's pattern) is merged on its own.  A segment tree over
the piece's byte positions holds, for every live position, the rank of the pair that starts there;
the root is the leftmost pair of lowest rank.  A merge updates the two live neighbours in logarithmic
time, so a piece of n bytes costs O(n log n) whatever it looks like.  A piece of at most SHORT bytes, as
nearly all are, is merged in a plain list of ranks, which is faster at that length.

Rows stay in their partitions: there is no shuffle.  Each Python worker keeps a bounded table of
pieces it has met, so that a frequent word is merged once.

Defined cases: a null or empty text gives no ids and empty bytes; an empty table gives no rows; repeated
rows are encoded alike; a very long text or piece is encoded whole; other columns pass through untouched,
but for those with the names of the output, which are replaced.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_NONE = 1 << 62
#: Bytes of a piece up to which a list of ranks is searched from end to end for each merge.
SHORT = 128
#: Bounds of a worker's table of met pieces: entries of each of its two generations (about 50 MB each), and bytes of a piece that is kept.
CACHE_PIECES, CACHE_BYTES = 250_000, 48


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file (`base64 rank` lines), read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTree:
    """Leftmost minimum over a fixed number of positions; values have the position in their lowest bits."""

    def __init__(self, values: list[int]):
        self.bits = max(0, (len(values) - 1).bit_length())
        self.size = 1 << self.bits
        level = values + [_NONE] * (self.size - len(values))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.tree = [_NONE]
        for level in reversed(levels):
            self.tree += level

    def least(self) -> int:
        return self.tree[1]

    def put(self, *changes: tuple[int, int]) -> None:
        """(position, value) pairs; each climbs as far as minima change."""
        tree, size = self.tree, self.size
        for position, value in changes:
            i = size + position
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merge_short(piece, ranks) if len(piece) <= SHORT else merge_long(piece, ranks)


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece in a time that grows with the square of its length."""
    n, get = len(piece), ranks.get
    at = list(range(n + 1))  # where the live tokens start, and the piece's end
    pairs = [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
    while pairs and (best := min(pairs)) < _NONE:
        i = pairs.index(best)
        del at[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], _NONE)
        if i < len(pairs):
            pairs[i] = get(piece[at[i] : at[i + 2]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by a segment tree over its positions."""
    n, get = len(piece), ranks.get
    bits = (n - 1).bit_length()
    mask = (1 << bits) - 1
    end = list(range(1, n + 1))  # end of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before
    pairs = [get(piece[i : i + 2]) for i in range(n - 1)]
    tree = SegmentTree([_NONE if r is None else r << bits | i for i, r in enumerate(pairs)] + [_NONE])
    nodes, put = tree.tree, tree.put
    while (best := nodes[1]) < _NONE:
        i = best & mask
        j = end[i]
        k = end[i] = end[j]
        own = left = _NONE
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                own = r << bits | i
        h = before[i]
        if h >= 0:
            if (r := get(piece[h:k])) is not None:
                left = r << bits | h
            put((j, _NONE), (i, own), (h, left))
        else:
            put((j, _NONE), (i, own))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _little(ids: list[int]) -> bytes:
    """Unsigned 32-bit little-endian integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Text -> ids as little-endian unsigned 32-bit integers; the dictionary holds met pieces.

    When it is full it becomes the older generation, out of which pieces that are met again return."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.older, self.vocabulary = ranks, regex.compile(pattern).findall, {}, None
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.token[v] = k

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = _little(encode_piece(raw, self.ranks))
            if len(raw) > CACHE_BYTES:
                return ids
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, packed: list[bytes]) -> pa.Array:
        """The bytes of each row's ids: tokens taken from the vocabulary, back to back."""
        if self.vocabulary is None:
            self.vocabulary = pa.array(self.token, pa.binary())
        count = np.cumsum([0, *(len(x) // 4 for x in packed)])
        out = []
        lo = 0
        while lo < len(packed):  # rows of some million tokens at once, so that 32-bit offsets suffice
            hi = max(lo + 1, int(np.searchsorted(count, count[lo] + (1 << 22), "right")) - 1)
            ids = np.frombuffer(b"".join(packed[lo:hi]), "<u4")
            taken = self.vocabulary.take(pa.array(ids)) if len(ids) else pa.array([], pa.binary())
            _, offsets, data = taken.buffers()
            offsets = np.frombuffer(offsets, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            rows = np.ascontiguousarray(offsets[count[lo : hi + 1] - count[lo]])
            out.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(rows), data if data is not None else pa.py_buffer(b"")]))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())


#: The encoder of the last vocabulary that this worker process used; later tasks find its table filled.
_LAST: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """docs plus `ids` (binary: unsigned 32-bit little-endian) and, if named, `decoded` (binary: the bytes of those ids)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the corpus
    name = uuid.uuid4().hex
    names = [c for c in (ids, decoded) if c]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.BinaryType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _LAST.get(name)
        if encoder is None:
            _LAST.clear()
            encoder = _LAST[name] = Encoder(shared.value, pattern)
        for batch in batches:
            at, size = 0, max(1, min(512, 1 + (8 << 20) * batch.num_rows // max(1, batch.nbytes)))
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at += size
                packed = [encoder.encode(x) if x else b"" for x in part.column(text).to_pylist()]
                columns = [*part.columns, pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(encoder.decode(packed))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)
