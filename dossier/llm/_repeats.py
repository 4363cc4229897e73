"""Where do windows of L symbols (bytes or words) repeat?  The frame shared by operators 3 and 10.

Shuffling every suffix of the corpus would cost many times its size.  Instead each window is known by
its *anchor*: the leftmost smallest of its k-gram hashes.  Equal windows have equal anchors at equal
offsets, and neighbouring windows mostly share one, so there is about one anchor per (L - k) / 2 symbols.

1. `anchors`: one row for each document and distinct anchor gram.
2. `shared_grams`: rows sorted by gram; grams that stand at one place only drop out.  A gram of more
   than HOT runs is marked hot.  The rows (28 bytes a document) stream by; nothing is gathered.
3. `contexts`: for each anchor with a shared gram, the symbols its windows cover, sent to the gram's
   partition.  For a hot gram that prefix is too short: its windows are told apart by their whole
   length.  They travel one by one, with their symbols, to the partition of the longer prefix, and of
   equal ones in a batch one.
4. `judge`: partitions are sorted by prefix and taken in memory-sized groups of whole prefixes; the
   operator's own index finds the equal windows of a group.  Windows of a long prefix stream by: of
   each, one is carried on.
5. the flagged window starts go back to their documents.

Whether windows are equal is always said by the operator's index over their symbols (suffix buckets,
suffix tree): `classes(symbols, starts)` gives a number for each window, the same for equal ones.

A document is known by its id and a hash of its text, so ids need not be unique: rows that share both
are judged as rows of their own, and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm._pack import whole_number
from dossier.llm._text import U64, binary_column, gram_hashes, mix, prefix_sums, ragged, row_groups, sliding_min, span_hashes, string_buffers

#: Runs of one gram beyond which it is split by longer prefixes, and symbol bytes that are judged at once.
HOT, GROUP_BYTES = 5_000, 1 << 20
_POS = U64((1 << 28) - 1)
KEY = ["_d", "_v"]


class Kind:
    """What a symbol is.  split(buf, offs) -> (codes uint64, first symbol of each row, symbols as sent)."""

    def __init__(self, split: Callable, dtype: type, window: int, gram: int):
        self.split, self.dtype, self.window, self.gram = split, np.dtype(dtype), window, gram

    def runs(self, codes: np.ndarray, first: np.ndarray):
        """Runs of windows with one anchor: row, first and last start, anchor, its gram's hash, and all codes' sums."""
        sums, L = prefix_sums(codes), self.window
        n = len(codes) - L + 1
        z = np.zeros(0, np.int64)
        if n <= 0:
            return z, z, z, z, np.zeros(0, U64), sums
        if len(codes) > _POS:
            raise ValueError(f"a text of more than {int(_POS)} symbols; cut it first")
        grams = gram_hashes(sums, self.gram)
        least = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=U64), L - self.gram + 1)
        anchor = (least & _POS).astype(np.int64)
        size = np.diff(first)
        ok = np.arange(n) + L <= np.repeat(first[1:], size)[:n]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        a = anchor[lo]
        return np.searchsorted(first, lo, "right") - 1, lo, hi, a, grams[a], sums


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs plus _d (the id; null as the least long) and _v (a hash of the text)."""
    whole_number(docs, key)
    return docs.withColumns({"_d": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "_v": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def _pieces(batch: pa.RecordBatch, text: str, kind: Kind):
    buf, offs = string_buffers(batch.column(text))
    for lo, hi in row_groups(offs):
        yield lo, hi, *kind.split(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def anchors(docs: DataFrame, text: str, kind: Kind) -> DataFrame:
    """_h, _d, _v, _n (of how many runs of the document the gram is the anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v = batch.column("_d").to_numpy(), batch.column("_v").to_numpy()
            for lo, _, codes, first, _ in _pieces(batch, text, kind):
                row, _, _, _, h, _ = kind.runs(codes, first)
                if not len(h):
                    continue
                at = np.lexsort((h, row))
                row, h = row[at], h[at]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
                count = np.diff(np.append(start, len(h))).astype(np.int32)
                r = row[start] + lo
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(d[r]), pa.array(v[r]), pa.array(count)], names=["_h", "_d", "_v", "_n"])

    return docs.select("_d", "_v", text).mapInArrow(run, "_h long, _d long, _v long, _n int")


def shared_grams(rows: DataFrame, hot: int) -> DataFrame:
    """_d, _v, _grams, _hot: each document's shared grams, and those of them that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h, d, v, n, is_hot):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, d, v, np.full(len(h), is_hot))], names=["_h", "_d", "_v", "_is_hot"])

        carry, burning = None, None
        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_d", "_v", "_n"))
            if burning is not None:
                k = int(np.searchsorted(now[0], burning, "right"))
                yield from out(*(x[:k] for x in now), True)
                now = tuple(x[k:] for x in now)
                if not len(now[0]):
                    continue
                burning = None
            if carry is not None:
                now = tuple(np.concatenate(x) for x in zip(carry, now))
            h = now[0]
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            keep = int(start[-1])
            yield from settle(tuple(x[:keep] for x in now), start[:-1], out)
            carry = tuple(x[keep:] for x in now)
            if carry[3].sum() > hot:
                yield from out(*carry, True)
                burning, carry = carry[0][0], None
        if carry is not None and len(carry[0]):
            yield from settle(carry, np.zeros(1, np.int64), out)

    def settle(now, start, out):
        if not len(start):
            return
        size = np.diff(np.append(start, len(now[0])))
        runs = np.add.reduceat(now[3].astype(np.int64), start)
        shared, hot_group = runs > 1, runs > hot
        for is_hot in (False, True):
            mask = np.repeat(shared & (hot_group == is_hot), size)
            yield from out(*(x[mask] for x in now), is_hot)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "_h").sortWithinPartitions("_h").mapInArrow(run, "_h long, _d long, _v long, _is_hot boolean")
    return found.groupBy(*KEY).agg(F.collect_set("_h").alias("_grams"), F.collect_set(F.when(F.col("_is_hot"), F.col("_h"))).alias("_hot"))


_CONTEXT = "_h long, _kind byte, _d long, _v long, _lo int, _hi int, _symbols binary"


def contexts(docs: DataFrame, text: str, kind: Kind, classes: Callable) -> DataFrame:
    """Rows of kind 0 (a run of windows with their symbols), 2 (one window of a hot gram, under its whole
    length), 1 (starts that repeat in their own batch; judged) or 3 (starts that those repeat)."""
    L = kind.window

    def emit(h, k, d, v, lo, hi, symbols):
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, k, np.int8)), pa.array(d), pa.array(v), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), symbols or pa.nulls(n, pa.binary())], names=[x.split()[0] for x in _CONTEXT.split(", ")])

    def settled(k, d, v, lo, hi):
        """Rows that need no judging go to any partition."""
        spread = mix(d.view(U64) + v.view(U64) * U64(3) + lo.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
        return emit(spread, k, d, v, lo, hi, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v = batch.column("_d").to_numpy(), batch.column("_v").to_numpy()
            lists = {c: (np.asarray(batch.column(c).flatten()), batch.column(c).offsets.to_numpy()) for c in ("_grams", "_hot")}

            def members(c, lo, hi, row, h):
                """Of (row, h), which are in that row's list."""
                values, offs = lists[c]
                own = values[offs[lo] - offs[0] : offs[hi] - offs[0]]
                if not len(own):
                    return np.zeros(len(h), bool)
                of = np.repeat(np.arange(hi - lo), np.diff(offs[lo : hi + 1]))
                salt = lambda r, x: mix(x.view(U64) + r.astype(U64) * U64(0x9E3779B97F4A7C15))
                table = np.sort(salt(of, own))
                x = salt(row, h)
                return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x

            for first_row, end_row, codes, first, symbols in _pieces(batch, text, kind):
                row, lo, hi, _, h, sums = kind.runs(codes, first)
                use = members("_grams", first_row, end_row, row, h)
                row, lo, hi, h = row[use], lo[use], hi[use], h[use]
                if not len(h):
                    continue
                # Of equal windows in one document one is sent: they have one gram, which stands there several times.
                by = np.lexsort((h, row))
                twin = np.zeros(len(h), bool)
                twin[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (row[by[1:]] == row[by[:-1]])
                twin[by[:-1]] |= twin[by[1:]]
                short = np.flatnonzero(twin)
                keep = np.ones(len(h), bool)
                if len(short) > 1:
                    places = ragged(lo[short], hi[short] - lo[short] + 1)
                    of = np.repeat(short, hi[short] - lo[short] + 1)
                    same = classes(symbols, places)
                    order = np.lexsort((places, row[of], same))
                    again = np.zeros(len(places), bool)
                    again[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (row[of[order[1:]]] == row[of[order[:-1]]])
                    # A run goes if all its windows stood before in this document.
                    gone = np.ones(len(h), bool)
                    gone[of[~again]] = False
                    mask = np.zeros(len(h), bool)
                    mask[short] = True
                    keep = ~(mask & gone)
                    first_again = np.zeros(len(places), bool)
                    first_again[order[:-1]] = again[order[1:]] & ~again[order[:-1]]
                    done = np.flatnonzero(~keep)
                    at = row[done] + first_row
                    base = first[row[done]]
                    if len(done):
                        yield settled(1, d[at], v[at], lo[done] - base, hi[done] - base)
                    lead = places[first_again]
                    at, base = row[of[first_again]] + first_row, first[row[of[first_again]]]
                    if len(lead):  # where a removed run's windows stood first: kind 3 says that they are repeated, not where
                        yield settled(3, d[at], v[at], lead - base, lead - base)
                    row, lo, hi, h = row[keep], lo[keep], hi[keep], h[keep]
                burning = members("_hot", first_row, end_row, row, h)
                if burning.any():
                    size = hi[burning] - lo[burning] + 1
                    places, of = ragged(lo[burning], size), np.repeat(np.flatnonzero(burning), size)
                    at, start, same = row[of] + first_row, places - first[row[of]], classes(symbols, places)
                    # Combined here: of equal windows the earliest goes on, the others are judged by it.
                    order = np.lexsort((start, d[at], same))
                    places, at, start, same = places[order], at[order], start[order], same[order]
                    lead = _leads(same)
                    told = (d[at] != d[at[lead]]) | (start != start[lead])
                    ahead = np.unique(lead[told])
                    yield settled(1, d[at[told]], v[at[told]], start[told], start[told])
                    yield settled(3, d[at[ahead]], v[at[ahead]], start[ahead], start[ahead])
                    left = np.flatnonzero(~told)
                    for k in range(0, len(left), 5_000):
                        own = left[k : k + 5_000]
                        size = np.full(len(own), L)
                        yield emit(span_hashes(sums, places[own], places[own] + L).view(np.int64), 2, d[at[own]], v[at[own]], start[own], start[own], binary_column(symbols[ragged(places[own], size)], size * kind.dtype.itemsize))
                    row, lo, hi, h = row[~burning], lo[~burning], hi[~burning], h[~burning]
                for k in range(0, len(h), 20_000):
                    s = slice(k, k + 20_000)
                    size = hi[s] - lo[s] + L
                    at, base = row[s] + first_row, first[row[s]]
                    if len(size):
                        yield emit(h[s].view(np.int64), 0, d[at], v[at], lo[s] - base, hi[s] - base, binary_column(symbols[ragged(lo[s], size)], size * kind.dtype.itemsize))

    # All columns go in, used or not: pruning them here would give the exchange below another shape than the
    # result's, and the texts would be dealt twice.
    return docs.mapInArrow(run, _CONTEXT)


def _leads(sorted_classes: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of its value."""
    new = np.ones(len(sorted_classes), bool)
    new[1:] = sorted_classes[1:] != sorted_classes[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)


def judge(rows: DataFrame, kind: Kind, classes: Callable, keep_first: bool) -> DataFrame:
    """_d, _v, _lo, _hi: runs of flagged window starts: all that repeat, or (keep_first) all but the earliest."""
    item, L = kind.dtype.itemsize, kind.window

    def repeat(same, d, start):
        if not keep_first:
            return np.bincount(same)[same] > 1 if len(same) else np.zeros(0, bool)
        order = np.lexsort((start, d, same))
        lead = order[_leads(same[order])]
        mask = np.zeros(len(same), bool)
        mask[order] = (d[order] != d[lead]) | (start[order] != start[lead])
        return mask

    def symbols_of(table: pa.Table):
        raw = table["_symbols"].chunk(0) if table["_symbols"].num_chunks else pa.array([], pa.binary())
        data, offs = string_buffers(raw)
        return np.ascontiguousarray(data).view(kind.dtype), offs[:-1] // item

    def group(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        symbols, begin = symbols_of(t)
        d, v, lo, hi = (t[c].to_numpy() for c in ("_d", "_v", "_lo", "_hi"))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        count = hi - lo + 1
        of = np.repeat(np.arange(len(lo)), count)
        start = ragged(lo, count)
        mask = repeat(classes(symbols, ragged(begin, count)), d[of], start)
        new = mask.copy()
        new[1:] &= ~mask[:-1] | (of[1:] != of[:-1])
        last = mask.copy()
        last[:-1] &= ~mask[1:] | (of[1:] != of[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        return flagged(d[of[a]], v[of[a]], start[a], start[b])

    def hot(batch: pa.RecordBatch, carried):
        """Judges windows of long prefixes; carried, and returned: the first of each window of the last prefix, and whether it was flagged."""
        t = pa.Table.from_batches([*([carried[0]] if carried else []), batch]).combine_chunks()
        old = carried[0].num_rows if carried else 0
        symbols, begin = symbols_of(t)
        h, d, v, lo = (t[c].to_numpy() for c in ("_h", "_d", "_v", "_lo"))
        same = classes(symbols, begin)
        mask = repeat(same, d, lo.astype(np.int64))
        say = mask.copy()
        say[:old] &= ~carried[1] if carried else True
        if keep_first:
            say[:old] = False
        at = np.flatnonzero(h == h[-1])
        at = np.sort(at[np.unique(same[at], return_index=True)[1]])
        return flagged(d[say], v[say], lo[say], lo[say]), (t.take(pa.array(at)).combine_chunks().to_batches()[0], mask[at])

    def flagged(d, v, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(v), pa.array(np.asarray(lo).astype(np.int32)), pa.array(np.asarray(hi).astype(np.int32))], names=["_d", "_v", "_lo", "_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last_h = [], 0, None
        carried = None
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            k = batch.column("_kind").to_numpy()
            passed = batch.filter(pa.array((k == 1) | ((k == 3) & (not keep_first))))
            if passed.num_rows:
                yield flagged(*(passed.column(c).to_numpy() for c in ("_d", "_v", "_lo", "_hi")))
            if (k == 2).any():
                out, carried = hot(batch.filter(pa.array(k == 2)), carried)
                yield out
            batch = batch.filter(pa.array(k == 0))
            while batch.num_rows:
                h = batch.column("_h").to_numpy()
                if size >= GROUP_BYTES:
                    stay = int(np.searchsorted(h, last_h, "right"))  # the rest of the last gram belongs to this group
                    if stay:
                        held.append(batch.slice(0, stay))
                    if stay < batch.num_rows:
                        yield group(held)
                        held, size = [], 0
                    batch = batch.slice(stay)
                    continue
                held.append(batch)
                size += batch.nbytes
                last_h = h[-1]
                break
        if held:
            yield group(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.repartition(n, "_h").sortWithinPartitions("_h", "_kind", "_d", "_lo")
    return ready.mapInArrow(run, "_d long, _v long, _lo int, _hi int")


def repeated(docs: DataFrame, text: str, kind: Kind, classes: Callable, keep_first: bool, hot: int | None = None) -> DataFrame:
    """docs (keyed) plus _runs: array<struct<_lo, _hi>> of flagged window starts, in symbols of the document (null: none)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(n, *KEY)  # one exchange, read for the contexts and for the result
    grams = shared_grams(anchors(docs, text, kind), HOT if hot is None else hot)
    rows = contexts(dealt.join(grams, KEY), text, kind, classes)
    # A set: every repeated row of one document and version flags the same runs.
    runs = judge(rows, kind, classes, keep_first).groupBy(*KEY).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_runs"))
    return dealt.join(runs, KEY, "left")


def covered(runs: pa.Array, first: np.ndarray, window: int, lo: int, hi: int) -> np.ndarray:
    """Mask over the symbols of rows lo .. hi - 1 (first: their first symbols): inside a flagged window."""
    part = runs.slice(lo, hi - lo)
    flat = part.flatten()
    lengths = np.asarray(part.value_lengths().fill_null(0)).astype(np.int64)
    base = np.repeat(first[:-1], lengths)
    a = base + np.asarray(flat.field("_lo")).astype(np.int64)
    b = base + np.asarray(flat.field("_hi")).astype(np.int64) + window
    edge = np.zeros(first[-1] + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge)[:-1] > 0
