"""Substring deduplication on bytes by bucket-pointer refinement of suffixes.

A byte goes if a string of `length` bytes over it also starts anywhere else, in this document or
another.  Suffixes that can matter are brought together by `_repeats` (an anchor gram each).  Within a
group, suffixes begin in buckets of equal q-grams; a bucket is refined by sorting its suffixes on the
bucket pointers of the suffixes further on, which doubles the depth, and the refined pointers are what
the next round reads: with the default of 16 bytes four rounds, to depths 32, 64, 128 and 200.  At depth
`length` the buckets of two or more are the repeats.

Defined cases: a null or empty text has no bytes; a text shorter than `length` keeps all; an empty table
gives no rows; of repeated rows (same id and text) each is a place of its own, so long ones go; ids may
be null or not unique, but are whole numbers (others raise TypeError); a text may have 2**28 bytes
(longer ones raise ValueError) and is taken whole; columns of the table pass through whatever their
names, but for those with the names of the output, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm._pack import pack, unpack
from dossier.llm._repeats import KEY, Kind, covered, keyed, repeated
from dossier.llm._text import BYTE_CODE, binary_column, gram_hashes, prefix_sums, row_groups, string_buffers

LENGTH, ANCHOR, BUCKET = 200, 48, 16
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _bytes(buf: np.ndarray, offs: np.ndarray):
    return BYTE_CODE[buf], offs, buf


def kind(length: int = LENGTH, anchor: int = ANCHOR) -> Kind:
    return Kind(_bytes, np.uint8, length, min(anchor, length))


class Buckets:
    """Bucket pointers of suffixes: equal for two suffixes if they agree in their first `depth` symbols.

    A bucket is refined by sorting its suffixes on the pointers of the suffixes `step` further on; the
    refined pointers are what the later rounds read.  Buckets of one are not sorted again: nothing else
    has their pointer at any greater depth."""

    def __init__(self, codes: np.ndarray, suffixes: np.ndarray, q: int):
        grams = gram_hashes(prefix_sums(codes), q)[suffixes]
        order = np.argsort(grams)
        self.pointer = np.zeros(len(codes) + 1, np.uint64)
        self.several = np.zeros(len(codes) + 1, bool)  # suffixes in a bucket of two or more
        self.rounds = self.used = 0
        self._number(suffixes[order], grams[order])

    def _number(self, suffixes: np.ndarray, keys: np.ndarray) -> None:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.pointer[suffixes] = np.cumsum(new).astype(np.uint64) + np.uint64(self.used)
        self.used += int(new.sum())
        alone = new.copy()
        alone[:-1] &= new[1:]
        self.several[suffixes] = ~alone

    def refine(self, suffixes: np.ndarray, step: int) -> None:
        """Refines the buckets of `suffixes` from their depth to `step` more."""
        suffixes = suffixes[self.several[suffixes]]
        keys = self.pointer[suffixes] << np.uint64(32) | self.pointer[suffixes + step]
        order = np.argsort(keys)
        self._number(suffixes[order], keys[order])
        self.rounds += 1


def buckets(codes: np.ndarray, suffixes: np.ndarray, length: int, q: int = BUCKET) -> Buckets:
    """The suffixes in buckets of depth `length`; each has at least `length` symbols."""
    q = min(q, length)
    depths = [q]
    while depths[-1] < length:
        depths.append(min(2 * depths[-1], length))
    steps = np.diff(depths).tolist()
    # Whose pointers the later rounds read: a suffix's own, and those further on.
    wanted = np.zeros(len(codes) + 1, bool)
    wanted[suffixes] = True
    rounds = [np.flatnonzero(wanted)]
    for step in reversed(steps):
        wanted[step:] |= wanted[:-step].copy()
        rounds.append(np.flatnonzero(wanted))
    out = Buckets(codes, rounds[-1], q)
    for step, of in zip(steps, reversed(rounds[:-1])):
        out.refine(of, step)
    return out


def classes(codes: np.ndarray, suffixes: np.ndarray, length: int, q: int = BUCKET) -> np.ndarray:
    """A number for each suffix, the same for those that begin with the same `length` symbols."""
    return buckets(codes, suffixes, length, q).pointer[suffixes].astype(np.int64) if len(suffixes) else np.zeros(0, np.int64)


def flag(docs: DataFrame, text: str, length: int, hot: int | None = None, anchor: int = ANCHOR, q: int = BUCKET) -> DataFrame:
    return repeated(docs, text, kind(length, anchor), lambda symbols, starts: classes(BYTE_CODE[symbols], starts, length, q), False, hot)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", hot: int | None = None, anchor: int = ANCHOR, q: int = BUCKET) -> DataFrame:
    """docs plus n_bytes long, removed_spans array<struct<start, end>> (bytes; maximal), kept_bytes binary."""
    clean, names = docs.drop("n_bytes", "removed_spans", "kept_bytes"), {"_key": key, "_text": text}
    found = _cut(pack(clean, **names), length, hot, anchor, q, False)
    return unpack(found, clean, {}, {"n_bytes": F.col("_bytes"), "removed_spans": F.col("_spans"), "kept_bytes": F.col("_kept")}, **names)


def _cut(packed: DataFrame, length: int, hot: int | None, anchor: int, q: int, as_text: bool) -> DataFrame:
    """packed (_key, _text, _row) plus _bytes, _spans and _kept (binary).

    as_text: _kept is a string (null for a null text); a character that a cut goes through goes whole."""
    found = flag(keyed(packed, "_key", "_text"), "_text", length, hot, anchor, q).select("_key", "_text", "_row", "_runs")
    schema = T.StructType([*packed.schema.fields, T.StructField("_bytes", T.LongType()), T.StructField("_spans", _SPANS), T.StructField("_kept", T.StringType() if as_text else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column("_text"))
            runs = batch.column("_runs")
            for lo, hi in row_groups(offs):
                piece, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                gone = covered(runs, o, length, lo, hi)
                before = np.concatenate([[0], np.cumsum(~gone)])
                edge = np.zeros(len(piece) + 1, bool)
                edge[o] = True  # spans end with their document
                start = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))) if len(piece) else np.zeros(0, np.int64)
                end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if len(piece) else start
                row = np.searchsorted(o, start, "right") - 1
                pairs = pa.StructArray.from_arrays([pa.array((start - o[row]).astype(np.int32)), pa.array((end - o[row]).astype(np.int32))], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), pairs)
                kept = binary_column(piece[~gone], np.diff(before[o]))
                part = batch.slice(lo, hi - lo)
                if as_text:
                    there = part.column("_text").is_valid().to_pylist()
                    kept = pa.array([b.decode("utf-8", "ignore") if t else None for b, t in zip(kept.to_pylist(), there)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(o)), spans, kept], names=schema.names)

    return found.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated strings, with their own columns.  A character that a cut
    goes through goes whole; a null text stays null."""
    names = {"_key": key, "_text": text}
    found = _cut(pack(docs, **names), length, None, ANCHOR, BUCKET, True)
    return unpack(found, docs, {text: F.col("_kept")}, **names)
