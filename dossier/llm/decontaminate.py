"""Benchmark decontamination by a prefix-filtered containment join.

Every item of the benchmark is cut into windows of `window` consecutive words (an item with fewer
words is one window).  A window is contained in a document if all its words stand there in a row.
The join goes by word shingles ordered by rarity:

1. document frequencies of the benchmark's shingles over the whole corpus give the order;
2. containment needs every shingle, so a prefix of one suffices: the window's rarest shingle.  Only
   documents that hold it become candidates;
3. length and positional bounds: the window must fit in the document around that shingle;
4. the candidate's words are compared with the window's, all of them.

The benchmark is the query side.  It is taken in blocks of at most BLOCK_BYTES of text, each small
enough to send to every worker; with one the corpus is not shuffled, with more the texts are, once.

Defined cases: a null or empty text or item has no words and no window; equal windows of several
items count for each of them; items with a null id mark words but are not listed; repeated rows are
judged alike; an empty table of documents gives no rows, an empty benchmark no hits; a very long text is
taken whole; other columns pass through whatever their names, but for those with the names of the output,
which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm._pack import pack, unpack
from dossier.llm._text import LOWER, NON_ALNUM, U64, Members, gram_hashes, prefix_sums, ragged, row_groups, string_buffers, word_hashes, word_spans

WINDOW, SHINGLE = 10, 5
#: Benchmark text that is held by a worker at once.
BLOCK_BYTES = 8 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]))


class Index:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int):
        buf, offs = string_buffers(pa.array([x for _, x in items], pa.string()))
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs, NON_ALNUM)
        words = word_hashes(buf, starts, ends)
        self.owners: list[list[str]] = []
        self.windows: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        for k, (item, _) in enumerate(items):
            own = words[first[k] : first[k + 1]]
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                w = own[i : i + window]
                j = known.setdefault(w.tobytes(), len(self.windows))
                if j == len(self.windows):
                    self.windows.append(w)
                    self.owners.append([])
                if item is not None and item not in self.owners[j]:
                    self.owners[j].append(item)
        self.shingle = shingle
        self.grams = [gram_hashes(prefix_sums(w), min(shingle, len(w))) for w in self.windows]
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})
        self.all = {n: np.unique(np.concatenate([g for g, w in zip(self.grams, self.windows) if min(shingle, len(w)) == n])) for n in self.sizes}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Chooses each window's rarest shingle."""
        chosen: dict[int, list[tuple[int, int, int]]] = {n: [] for n in self.sizes}
        for k, (g, w) in enumerate(zip(self.grams, self.windows)):
            n = min(self.shingle, len(w))
            at = min(range(len(g)), key=lambda i: (frequency.get((n, int(g[i])), 0), int(g[i]), i))
            chosen[n].append((int(g[at]), at, k))
        self.prefix = {}
        for n, rows in chosen.items():
            rows.sort()
            self.prefix[n] = (np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.flat = np.concatenate(self.windows)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.grams = self.windows = None


def _words(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) of bounded pieces of a batch."""
    buf, offs = string_buffers(batch.column(text))
    for lo, hi in row_groups(offs):
        piece, o = LOWER[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = word_spans(piece, o, NON_ALNUM)
        yield lo, hi, word_hashes(piece, starts, ends), first


def _frequencies(docs: DataFrame, text: str, index: Index) -> dict[tuple[int, int], int]:
    """In how many documents each of the block's shingles stands."""
    shared = docs.sparkSession.sparkContext.broadcast(index.all)

    def run(batches):
        sets = {n: Members(v) for n, v in shared.value.items()}
        counts = {n: np.zeros(len(v), np.int64) for n, v in shared.value.items()}
        for batch in batches:
            for _, _, words, first in _words(batch, text):
                sums = prefix_sums(words)
                row = np.searchsorted(first, np.arange(len(words)), "right") - 1
                for n, m in sets.items():
                    h = gram_hashes(sums, n)
                    at = m.where(h)
                    at = at[at + n <= first[row[at] + 1]]
                    pairs = np.unique(row[at] * len(m.values) + np.searchsorted(m.values, h[at]))
                    counts[n] += np.bincount(pairs % len(m.values), minlength=len(m.values))
        for n, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(c[at])], names=["n", "k", "c"])

    rows = docs.select(text).mapInArrow(run, "n int, k long, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).collect()
    return {(r["n"], int(index.all[r["n"]][r["k"]])): r["c"] for r in rows}  # as large as the block


def _scan(docs: DataFrame, text: str, index: Index) -> DataFrame:
    """docs plus n_words, hit_spans (word positions, disjoint, ascending) and item_ids."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))])

    def piece(index: Index, sets: dict[int, Members], words: np.ndarray, first: np.ndarray):
        sums, found = prefix_sums(words), []
        for n, (key, offset, window) in index.prefix.items():
            h = gram_hashes(sums, n)
            at = sets[n].where(h)
            left, right = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            entry, place = ragged(left, right - left), np.repeat(at, right - left)
            begin, w = place - offset[entry], window[entry]
            row = np.searchsorted(first, place, "right") - 1
            fits = (begin >= first[row]) & (begin + index.lengths[w] <= first[row + 1])
            begin, w, row = begin[fits], w[fits], row[fits]
            size = index.lengths[w]
            same = words[ragged(begin, size)] == index.flat[ragged(index.begin[w], size)]
            if len(begin):
                whole = np.add.reduceat(same, np.cumsum(size) - size) == size
                found.append(np.stack([row[whole], begin[whole] - first[row[whole]], size[whole], w[whole]]))
        spans, items = [[] for _ in range(len(first) - 1)], [[] for _ in range(len(first) - 1)]
        if found:
            hits = np.concatenate(found, axis=1)
            for r, b, n, w in hits[:, np.lexsort((hits[1], hits[0]))].T.tolist():
                own = spans[r]
                if own and b <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b + n)
                else:
                    own.append([b, b + n])
                items[r].append(w)
        return spans, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sets = {n: Members(np.unique(p[0])) for n, p in index.prefix.items()}
        for batch in batches:
            counts, spans, items = [], [], []
            for _, _, words, first in _words(batch, text):
                counts.append(np.diff(first))
                s, i = piece(index, sets, words, first)
                spans += s
                items += i
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans], dtype=np.int64)]).astype(np.int32)), pairs)
            ids = pa.array([sorted({x for w in set(i) for x in index.owners[w]}) for i in items], pa.list_(pa.string()))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), lists, ids], names=[*batch.schema.names, "n_words", "hit_spans", "item_ids"])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs plus n_words long, hit_spans array<struct<start, end>> and item_ids array<string> (sorted)."""
    clean = docs.drop("n_words", "hit_spans", "item_ids")
    found = _found(pack(clean, _text=text), benchmark, item, item_text, window, shingle)
    return unpack(found, clean, {}, {c: F.col(c) for c in ("n_words", "hit_spans", "item_ids")}, _text=text)


def _found(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, shingle: int) -> DataFrame:
    """docs (_text, _row) plus n_words, hit_spans and item_ids."""
    text = "_text"
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("body"))
    size = items.agg(F.sum(F.octet_length("body")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    indexes = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        index = Index([(r["item"], r["body"]) for r in own.collect()], window, shingle)
        if index.windows:
            indexes.append(index)
    if not indexes:
        indexes = [None]
    for index in indexes:
        if index:
            index.order(_frequencies(docs, text, index))
    if len(indexes) == 1:
        return _scan(docs, text, indexes[0] or _empty())
    # Several blocks: one pass each; what a text holds depends on nothing but the text, so hits meet by its digest.
    keyed = docs.withColumns({"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), F.reverse(text))})
    parts = None
    for index in indexes:
        p = _scan(keyed.select("_a", "_b", text), text, index).drop(text)
        parts = p if parts is None else parts.unionByName(p)
    merged = parts.groupBy("_a", "_b").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    return keyed.join(merged.withColumn("hit_spans", _union("hit_spans")), ["_a", "_b"]).drop("_a", "_b")


def _union(spans: str):
    """Disjoint ascending spans that cover the same words."""
    kind = "array<struct<start:int,end:int>>"

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))).cast(kind)
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, F.array(x).cast(kind)))

    return F.aggregate(F.array_sort(F.col(spans)), F.array().cast(kind), add)


def _empty() -> Index:
    index = object.__new__(Index)
    index.prefix, index.owners, index.lengths, index.flat, index.begin = {}, [], np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return index


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    text = options.pop("text", "text")
    names = {"item": "item_id", "item_text": "text", "window": WINDOW, "shingle": SHINGLE} | options
    found = _found(pack(docs, _text=text), benchmark, **names)
    return unpack(found.where(F.size("hit_spans") == 0), docs, _text=text)
