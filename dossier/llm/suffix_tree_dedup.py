"""Substring deduplication on words by prefix-partitioned suffix trees.

A word goes if a window of `window` words over it, with the same words, also starts earlier (in a
document of smaller id, or earlier in this one).  Suffixes are split by prefixes of variable length: the
anchor gram, `gram` words, and where that prefix is too frequent for one group the whole window
(`_repeats`).  Each group fits in memory and gets the suffix tree of its prefixes: suffixes in
lexicographic order with their common prefix lengths, whose intervals are the tree's internal nodes.
The nodes at depth `window` are the repeats; the earliest leaf of each stays.

Words are compared by 32 bits of their hash, so that windows of 20 words are told apart by 640 bits.

Defined cases: a null or empty text has no words; with fewer words than a window all stay; an empty
table gives no rows; rows with the same id are one document (a window at the same start is not earlier);
null ids come first; ids are whole numbers (others raise TypeError); a text may have 2**28 words (longer
ones raise ValueError) and is taken whole; columns of the table pass through whatever their names, but
for those with the names of the output, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm._pack import pack, unpack
from dossier.llm._repeats import Kind, covered, keyed, repeated
from dossier.llm._text import SPACE, U64, ragged, row_groups, string_buffers, word_hashes, word_spans

WINDOW, GRAM = 20, 5


def _split(buf: np.ndarray, offs: np.ndarray):
    starts, ends, first = word_spans(buf, offs, SPACE)
    h = word_hashes(buf, starts, ends)
    return h, first, (h >> U64(32)).astype(np.uint32)


def suffix_order(symbols: np.ndarray, begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in lexicographic order of their first `depth` symbols, and each one's common
    prefix length with the one before it (0 for the first): the suffix tree cut off at `depth`."""
    wide = np.append(symbols, np.zeros(1, symbols.dtype)).astype(U64)
    pairs = [wide[begin + i] << U64(32) | (wide[begin + i + 1] if i + 1 < depth else U64(0)) for i in range(0, depth, 2)]
    order = np.lexsort(pairs[::-1])
    at = begin[order]
    common = np.zeros(len(at), np.int64)
    alive = np.arange(1, len(at))
    for i in range(depth):
        alive = alive[symbols[at[alive] + i] == symbols[at[alive - 1] + i]]
        common[alive] += 1
    return order, common


def deep_nodes(symbols: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the number of the tree's node at that depth above it."""
    order, common = suffix_order(symbols, begin, depth)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(common < depth)  # leaves with the same number are below one deep node
    return out


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int | None = None) -> DataFrame:
    """docs plus n_words long, n_removed long, kept_text string (kept words joined by one space)."""
    clean, names = docs.drop("n_words", "n_removed", "kept_text"), {"_key": key, "_text": text}
    packed, kind = pack(clean, **names), Kind(_split, np.uint32, window, min(gram, window))
    nodes = lambda symbols, begin: deep_nodes(symbols, begin, window)
    found = repeated(keyed(packed, "_key", "_text"), "_text", kind, nodes, True, hot).select("_key", "_text", "_row", "_runs")
    schema = T.StructType([*packed.schema.fields, T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType()), T.StructField("_kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column("_text"))
            runs = batch.column("_runs")
            for lo, hi in row_groups(offs):
                piece = buf[offs[lo] : offs[hi]]
                starts, ends, first = word_spans(piece, offs[lo : hi + 1] - offs[lo], SPACE)
                gone = covered(runs, first, window, lo, hi)
                stay = np.flatnonzero(~gone)
                before = np.concatenate([[0], np.cumsum(~gone)])[first]
                size = ends[stay] - starts[stay] + 1  # a word and the space after it
                source = np.append(piece, np.uint8(32))
                place = ragged(starts[stay], size)
                out = source[np.minimum(place, len(piece))]
                stop = np.cumsum(size)
                out[stop - 1] = 32
                total = np.concatenate([[0], stop])[before]
                last = total[1:][np.diff(before) > 0] - 1  # no space after a document's last word
                keep = np.ones(len(out), bool)
                keep[last] = False
                lengths = np.diff(total) - (np.diff(before) > 0)
                o = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                kept = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(out[keep]))])
                part = batch.slice(lo, hi - lo)
                words = np.diff(first)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words), pa.array(words - np.diff(before)), kept], names=schema.names)

    out = found.mapInArrow(run, schema)
    return unpack(out, clean, {}, {"n_words": F.col("_words"), "n_removed": F.col("_removed"), "kept_text": F.col("_kept")}, **names)
