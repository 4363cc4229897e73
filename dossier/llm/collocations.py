"""Phrase collocations by compressed position bitmaps.

Texts are dealt, piece by piece, into shards of one language and about SHARD_BYTES.  In a shard every
position has a bit; a gap of one stands after each piece, so no phrase passes its end.  Each word has a
bitmap of its positions, compressed by leaving out the zero bytes (byte-aligned: sorted byte numbers and
masks).  A phrase is extended by shifting its bitmap one bit up and AND-ing it with the bitmaps of all words
that share a byte with it; what is left, counted by popcount, is the longer phrase's bitmap.

Supports are sums over shards.  A shard asks partitioned tables: first for its words, which gives a
frequent word its number and drops the rest; then for its pairs of frequent words; frequent pairs give a
bitmap of the positions where one ends, and every further extension is AND-ed with it, since a phrase is no
more frequent than its last pair.  Below the frequent pairs the shard goes depth first, in batches of
subtrees of some BATCH bytes of bitmaps, and sends the popcounts of phrases of 3 words and more to the
tables that add them up.  Phrases are sent as numbers of words, so counts are exact; words are told apart
by 64 bits of hash of word and language.

Defined cases: a null or empty text has no words; a null language is `und`; a word with an infrequent word
beside it ends there; repeated rows count each time; a text of any length is cut at ends of pieces, a piece
without an end stays whole; an empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm._cut import checkpointed
from dossier.llm._text import LOWER, PIECE_BYTES, U64, mix, planes, ragged, row_groups, string_buffers, whole, word_hashes, word_spans

#: Bytes of text in a shard, held in all open shards of a task, and behind each task of a table; entries of bitmaps extended at once.
SHARD_BYTES, OPEN_BYTES, TASK_BYTES, BATCH = 8 << 20, 24 << 20, 64 << 20, 200_000
UNKNOWN = "und"
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True

_SHARD = "s long, lang string, n long, keys binary, counts binary, sizes binary, words binary, bitmaps binary"
_ROW = "s long, k byte, p int, lang string, x binary, y binary"
_COUNTED = "lang string, ids array<long>, f long, word binary"


class Bitmaps:
    """Bitmaps of many owners: entries (owner, byte, mask), sorted by owner and byte; masks are not zero."""

    def __init__(self, owner: np.ndarray, byte: np.ndarray, mask: np.ndarray):
        self.owner, self.byte, self.mask = owner, byte, mask

    def __len__(self) -> int:
        return len(self.byte)

    def shifted(self) -> Bitmaps:
        """Every bitmap one bit up."""
        low, carry = self.mask << np.uint8(1), self.mask >> np.uint8(7)
        over = np.flatnonzero(carry)
        if len(over):
            # A carry falls into the owner's next byte, which is the next entry if it is there.
            after = np.minimum(over + 1, len(self) - 1)
            there = (over + 1 < len(self)) & (self.owner[after] == self.owner[over]) & (self.byte[after] == self.byte[over] + 1)
            low[after[there]] |= np.uint8(1)
            new = over[~there]
            owner, byte, mask = (np.insert(a, new + 1, v) for a, v in ((self.owner, self.owner[new]), (self.byte, self.byte[new] + 1), (low, np.uint8(1))))
        else:
            owner, byte, mask = self.owner, self.byte, low
        return Bitmaps(owner, byte, mask)._filled()

    def _filled(self) -> Bitmaps:
        some = self.mask != 0
        return self if some.all() else Bitmaps(self.owner[some], self.byte[some], self.mask[some])

    def within(self, dense: np.ndarray) -> Bitmaps:
        """AND with one bitmap of the whole shard."""
        return Bitmaps(self.owner, self.byte, self.mask & dense[self.byte])._filled()

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Owners in order, and the set bits of each."""
        if not len(self):
            return self.owner, np.zeros(0, np.int64)
        head = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
        return self.owner[head], np.add.reduceat(np.bitwise_count(self.mask).astype(np.int64), head)

    def batches(self) -> Iterator[Bitmaps]:
        """Runs of whole owners of about BATCH entries."""
        lo = 0
        while lo < len(self):
            hi = int(np.searchsorted(self.owner, self.owner[min(lo + BATCH, len(self)) - 1], "right"))
            yield Bitmaps(self.owner[lo:hi], self.byte[lo:hi], self.mask[lo:hi])
            lo = hi


class Index:
    """A shard's word bitmaps, also by byte: the words of each byte."""

    def __init__(self, words: Bitmaps):
        self.words = words
        order = np.argsort(words.byte, kind="stable")
        self.word, self.mask = words.owner[order], words.mask[order]
        self.size = int(words.byte.max(initial=-1)) + 2
        self.at = np.searchsorted(words.byte[order], np.arange(self.size + 1))

    def extended(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """Shifted phrases AND words: for each child its parent and its word; the children's bitmaps, owned 0, 1, ..."""
        first, count = self.at[phrases.byte], self.at[phrases.byte + 1] - self.at[phrases.byte]
        there = ragged(first, count)
        mask = np.repeat(phrases.mask, count) & self.mask[there]
        some = np.flatnonzero(mask)
        of = np.repeat(np.arange(len(phrases), dtype=np.int32), count)[some]
        word, mask = self.word[there[some]], mask[some]
        key = phrases.owner[of].astype(np.int64) << 32 | word
        order = np.argsort(key, kind="stable")  # bytes stay in order
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        head = key[new]
        return head >> 32, head & 0xFFFFFFFF, Bitmaps(np.cumsum(new) - 1, phrases.byte[of][order], mask[order])


def _split(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.diff(p[order], prepend=-1, append=-1)) if len(p) else []
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(p[order[a]]), order[a:b]


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int8(), pa.int32(), pa.string(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [[]] * 6
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["s", "k", "p", "lang", "x", "y"])


class _Open:
    """A shard that is being filled."""

    def __init__(self):
        self.bytes, self.texts, self.starts, self.ends, self.gaps = 0, [], [], [], []

    def add(self, raw: np.ndarray, offs: np.ndarray) -> None:
        """Texts, back to back."""
        buf = LOWER[raw]
        starts, ends, first = word_spans(buf, offs, _BREAKS)
        gap = np.zeros(len(starts), bool)  # before the word
        if len(starts):
            ended = np.concatenate([[0], np.cumsum(_ENDS[buf])])
            gap[1:] = ended[starts[1:]] != ended[ends[:-1]]
            gap[first[:-1][first[:-1] < len(starts)]] = True
        self.texts.append(buf), self.starts.append(starts + self.bytes), self.ends.append(ends + self.bytes), self.gaps.append(gap)
        self.bytes += len(buf)

    def closed(self, s: int, lang: str) -> tuple:
        buf, starts, ends, gap = (np.concatenate(x) for x in (self.texts, self.starts, self.ends, self.gaps))
        tongue = np.frombuffer(lang.encode(), np.uint8)
        salt = word_hashes(tongue, np.array([0]), np.array([len(tongue)]))[0] if len(tongue) else U64(0)
        hashes = np.concatenate([word_hashes(t, a - at, b - at) for t, a, b, at in zip(self.texts, self.starts, self.ends, np.cumsum([0, *map(len, self.texts)]).tolist())])
        keys, lead, word, count = np.unique(mix(hashes ^ mix(np.array([salt]))), return_index=True, return_inverse=True, return_counts=True)
        position = np.arange(len(word)) + np.cumsum(gap)
        sizes = (ends - starts)[lead]
        bitmaps = _of_positions(word, position)
        return (s, lang, len(word), keys.tobytes(), planes(count, 4), planes(sizes, 5), buf[ragged(starts[lead], sizes)].tobytes(), _stored(bitmaps, len(keys)))


def _of_positions(word: np.ndarray, position: np.ndarray) -> Bitmaps:
    order = np.argsort(word, kind="stable")
    word, position = word[order], position[order]
    byte, bit = position >> 3, (np.uint8(1) << (position & 7).astype(np.uint8))
    if not len(word):
        return Bitmaps(word, byte, bit)
    head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (byte[1:] != byte[:-1])]))
    return Bitmaps(word[head], byte[head], np.bitwise_or.reduceat(bit, head))


def _stored(b: Bitmaps, n: int) -> bytes:
    """Numbers of entries, steps between bytes (of each owner's first: the byte), masks; packed."""
    step = np.diff(b.byte, prepend=0)
    head = np.concatenate([[True], b.owner[1:] != b.owner[:-1]]) if len(b) else np.zeros(0, bool)
    step[head] = b.byte[head]
    raw = planes(np.bincount(b.owner, minlength=n), 4) + planes(step, 4) + b.mask.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loaded(raw: bytes, n: int) -> Bitmaps:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    count = whole(raw[: 4 * n], 4)
    m = int(count.sum())
    step, mask = whole(raw[4 * n : 4 * (n + m)], 4), np.frombuffer(raw, np.uint8, m, 4 * (n + m))
    total = np.cumsum(step)
    before = np.concatenate([[0], total])[np.cumsum(count) - count]
    return Bitmaps(np.repeat(np.arange(n), count), total - np.repeat(before, count), mask)


def _cuts(raw: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A text in parts of some PIECE_BYTES that end where a piece ends."""
    while lo < hi:
        to, wide = hi, PIECE_BYTES
        while lo + wide < hi:
            ends = np.flatnonzero(_ENDS[raw[lo : lo + wide]])
            if len(ends):
                to = lo + int(ends[-1]) + 1
                break
            wide *= 2
        yield lo, to
        lo = to


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    held: dict[str, _Open] = defaultdict(_Open)

    def close(lang: str) -> pa.RecordBatch:
        nonlocal at
        row = held.pop(lang).closed(at, lang)
        at += 1
        names, kinds = zip(*(x.split() for x in _SHARD.split(", ")))
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for v, k in zip(row, kinds)], names=list(names))

    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            raw, offs = string_buffers(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
            for lo, hi in row_groups(offs):
                parts = [(offs[lo], offs[hi], offs[lo : hi + 1] - offs[lo])] if hi > lo + 1 else [(a, b, np.array([0, b - a])) for a, b in _cuts(raw, int(offs[lo]), int(offs[hi]))]
                for a, b, own in parts:
                    held[lang].add(raw[a:b], own)
                    if held[lang].bytes >= SHARD_BYTES:
                        yield close(lang)
                    while sum(x.bytes for x in held.values()) > OPEN_BYTES:
                        yield close(max(held, key=lambda x: held[x].bytes))
    for lang in list(held):
        yield close(lang)


class Shard:
    """A shard whose words have their numbers; infrequent words' bits are gone."""

    def __init__(self, row: dict, replies: list[dict], parts: int):
        keys = np.frombuffer(row["keys"], U64)
        number = np.zeros(len(keys), np.int64)
        answers = {x["p"]: whole(x["x"]) for x in replies if x["k"] == 0}
        for p, own in _split(_part(keys, parts)):
            number[own] = answers[p]
        bits = _loaded(row["bitmaps"], len(keys))
        bits = Bitmaps(bits.owner, bits.byte, bits.mask) if number.all() else _only(bits, number > 0)
        # Owners are places in the sorted list of numbers.
        self.numbers = np.sort(number[number > 0])
        place = np.searchsorted(self.numbers, number)
        owner = place[bits.owner]
        order = np.argsort(owner, kind="stable")
        self.index = Index(Bitmaps(owner[order], bits.byte[order], bits.mask[order]))

    def pairs(self, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, Bitmaps]]:
        """First words, second words and bitmaps of pairs, subtrees in order; with `ends`, of those that end there."""
        for batch in self.index.words.batches():
            up = batch.shifted()
            yield self.index.extended(up if ends is None else up.within(ends))

    def frequent_ends(self, replies: list[dict], parts: int) -> np.ndarray:
        """The bitmap of the positions where a frequent pair ends."""
        out = np.zeros(self.index.size + 1, np.uint8)
        found = [(self.numbers[a], self.numbers[b], bits) for a, b, bits in self.pairs()]
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        flag = np.zeros(len(a), bool)
        answers = {x["p"]: x["x"] for x in replies if x["k"] == 1}
        for p, own in _split(_part(a.astype(U64) << U64(32) | b.astype(U64), parts)):
            flag[own] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(own)).astype(bool)
        at = 0
        for first, _, bits in found:
            own = flag[at : at + len(first)][bits.owner]
            np.bitwise_or.at(out, bits.byte[own], bits.mask[own])
            at += len(first)
        return out

    def longer(self, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of 3 .. most words (numbers, ended by zeros) and their popcounts, depth first by batches of subtrees."""

        def below(path: np.ndarray, bits: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in bits.batches():
                parent, word, children = self.index.extended(batch.shifted().within(ends))
                if not len(parent):
                    continue
                paths = np.column_stack([path[parent], self.numbers[word]])
                yield np.pad(paths, ((0, 0), (0, most - paths.shape[1]))), children.popcounts()[1]
                if paths.shape[1] < most:
                    yield from below(paths, children)

        for a, b, bits in self.pairs(ends):
            yield from below(np.column_stack([self.numbers[a], self.numbers[b]]), bits)


def _only(bits: Bitmaps, kept: np.ndarray) -> Bitmaps:
    own = kept[bits.owner]
    return Bitmaps(bits.owner[own], bits.byte[own], bits.mask[own])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(U64)) % U64(parts)).astype(np.int64)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stood first, where each given key is among them, their summed counts."""
    found, lead, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return found, lead, inverse, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def _counted(lang: list[str], ids: np.ndarray, f: np.ndarray, words: list[bytes | None]) -> pa.Table:
    used = (ids > 0).sum(1)
    offsets = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
    return pa.table([pa.array(lang, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[ids > 0], pa.int64())), pa.array(f, pa.int64()), pa.array(words, pa.binary())], names=["lang", "ids", "f", "word"])


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 .. longest words (lang, ids, f, word: the text where it is one word), and n by lang."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    # Partitions follow the bytes, so that no table's share grows with the corpus.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    shards = checkpointed(rows.mapInArrow(_shards, _SHARD))  # their numbers hold from here on

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                keys, counts, sizes = np.frombuffer(row["keys"], U64), whole(row["counts"], 4), whole(row["sizes"])
                begin, raw = np.cumsum(sizes) - sizes, np.frombuffer(row["words"], np.uint8)
                out = [(row["s"], 0, p, row["lang"], keys[own].tobytes(), planes(counts[own], 4) + planes(sizes[own], 5) + raw[ragged(begin[own], sizes[own])].tobytes()) for p, own in _split(_part(keys, parts))]
                yield from _rows(out).to_batches()

    def answer_words(table: pa.Table) -> pa.Table:
        p, asked = table["p"][0].as_py(), table.to_pylist()
        keys = [np.frombuffer(x["x"], U64) for x in asked]
        found, lead, inverse, total = _totals(keys, [whole(x["y"][: 4 * len(k)], 4) for x, k in zip(asked, keys)])
        often = total >= least
        number = np.zeros(len(found), np.int64)
        number[often] = np.arange(int(often.sum())) * parts + p + 1
        assert number.max(initial=0) < 1 << 32, "more frequent words than 32 bits can number"
        out, at = [], 0
        begins = np.cumsum([0, *map(len, keys)])
        for x, k in zip(asked, keys):
            out.append((x["s"], 0, p, x["lang"], planes(number[inverse[at : at + len(k)]]), None))
            at += len(k)
        # The frequent words themselves, from the request in which each stood first.
        first, by = lead[often], number[often]
        owner = np.searchsorted(begins, first, "right") - 1
        for r in np.unique(owner).tolist():
            m, mine = len(keys[r]), np.flatnonzero(owner == r)
            sizes = whole(asked[r]["y"][4 * m : 9 * m])
            begin, text = np.cumsum(sizes) - sizes, np.frombuffer(asked[r]["y"], np.uint8, offset=9 * m)
            local = first[mine] - begins[r]
            body = text[ragged(begin[local], sizes[local])].tobytes()
            out.append((-1, 2, p, asked[r]["lang"], planes(by[mine]), planes(total[often][mine], 5) + planes(sizes[local], 5) + body))
        return _rows(out)

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = whole(x["x"])
                m = len(ids)
                f, sizes = whole(x["y"][: 5 * m]), whole(x["y"][5 * m : 10 * m])
                ends = np.cumsum(sizes).tolist()
                body = x["y"][10 * m :]
                yield from _counted([x["lang"]] * m, ids[:, None], f, [body[b - n : b] for b, n in zip(ends, sizes.tolist())]).to_batches()

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            shard = Shard(row, right.to_pylist(), parts)
            got = [(shard.numbers[a], shard.numbers[b], bits.popcounts()[1]) for a, b, bits in shard.pairs()]
            if not got:
                continue
            a, b, f = (np.concatenate(x) for x in zip(*got))
            for p, own in _split(_part(a.astype(U64) << U64(32) | b.astype(U64), parts)):
                out.append((row["s"], 1, p, row["lang"], planes(np.concatenate([a[own], b[own]]), 4), planes(f[own], 4)))
        return _rows(out)

    def answer_pairs(table: pa.Table) -> pa.Table:
        p, asked = table["p"][0].as_py(), table.to_pylist()
        ids = [whole(x["x"], 4).reshape(2, -1) for x in asked]
        found, lead, inverse, total = _totals([a.astype(U64) << U64(32) | b.astype(U64) for a, b in ids], [whole(x["y"], 4) for x in asked])
        often = total >= least
        out, at = [], 0
        for x, (a, _) in zip(asked, ids):
            out.append((x["s"], 1, p, x["lang"], np.packbits(often[inverse[at : at + len(a)]]).tobytes(), None))
            at += len(a)
        owner = np.searchsorted(np.cumsum([len(a) for a, _ in ids]), lead[often], "right")
        for r in np.unique(owner).tolist():
            mine = np.flatnonzero(often)[owner == r]
            out.append((-1, 3, p, asked[r]["lang"], found[mine].tobytes(), planes(total[mine], 5)))
        return _rows(out)

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                key = np.frombuffer(x["x"], U64)
                ids = np.column_stack([key >> U64(32), key & U64(0xFFFFFFFF)]).astype(np.int64)
                yield from _counted([x["lang"]] * len(ids), ids, whole(x["y"]), [None] * len(ids)).to_batches()

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out, replies = [], right.to_pylist()
        for row in left.to_pylist():
            shard = Shard(row, replies, parts)
            got = list(shard.longer(shard.frequent_ends(replies, parts), longest))
            if not got:
                continue
            paths, f = (np.concatenate(x) for x in zip(*got))
            key = np.zeros(len(paths), U64)
            for c in range(longest):
                key = mix(key + paths[:, c].astype(U64))
            for p, own in _split(_part(key, parts)):
                out.append((row["s"], 4, p, row["lang"], planes(paths[own].T.ravel(), 4), planes(f[own], 4)))
        return _rows(out)

    def answer_longer(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        paths = np.concatenate([whole(x["x"], 4).reshape(longest, -1).T for x in asked])
        f = np.concatenate([whole(x["y"], 4) for x in asked])
        begins = np.cumsum([len(x["y"]) // 4 for x in asked])
        order = np.lexsort(paths.T[::-1])
        paths = paths[order]
        head = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(1)]))
        total = np.add.reduceat(f[order], head)
        often = total >= least
        of = np.searchsorted(begins, order[head[often]], "right")
        return _counted([asked[r]["lang"] for r in of.tolist()], paths[head[often]], total[often], [None] * int(often.sum()))

    asks = shards.select("s", "lang", "keys", "counts", "sizes", "words").mapInArrow(ask_words, _ROW)
    words = checkpointed(asks.repartition(parts, "p").groupBy("p").applyInArrow(answer_words, _ROW))
    dealt = shards.select("s", "lang", "keys", "bitmaps").repartition(parts, "s")
    numbered = words.where("k = 0")
    pairs = dealt.groupBy("s").cogroup(numbered.repartition(parts, "s").groupBy("s")).applyInArrow(ask_pairs, _ROW)
    pairs = checkpointed(pairs.repartition(parts, "p").groupBy("p").applyInArrow(answer_pairs, _ROW))
    found = words.where("k = 2").mapInArrow(word_rows, _COUNTED).unionByName(pairs.where("k = 3").mapInArrow(pair_rows, _COUNTED))
    if longest > 2:
        replies = numbered.unionByName(pairs.where("k = 1")).repartition(parts, "s")
        more = dealt.groupBy("s").cogroup(replies.groupBy("s")).applyInArrow(extend, _ROW)
        found = found.unionByName(more.repartition(parts, "p").groupBy("p").applyInArrow(answer_longer, _COUNTED))
    return checkpointed(found), shards.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, closed: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    A phrase's score is its worst cut's floor(1000 * a * n / (l * r)).  Phrases of `least` occurrences at least;
    one whose words lie in a longer frequent phrase that has `closed` hundredths of its occurrences is dropped."""
    found, totals = phrases(docs, least, longest, text, lang)
    candidates = found.where(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"))
    # A phrase within a longer one lies within one that is longer by one word and no less frequent.
    n = F.size("ids")
    above = candidates.where(n > 2).select("a", F.explode(F.array(F.slice("ids", F.lit(1), n - 1), F.slice("ids", F.lit(2), n - 1))).alias("ids")).groupBy("ids").agg(F.max("a").alias("above"))
    kept = candidates.join(above, "ids", "left").where(F.coalesce(F.col("above") * 100 < F.col("a") * closed, F.lit(True)))
    cuts = kept.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k")).withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    counts = found.select(F.col("ids").alias("part"), "f")
    cuts = cuts.join(counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right").join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("1000BD * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    worst = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "ids", "a", "n", "w.score", "w.l", "w.r")
    # Ties at the end of a list stay until their texts decide.
    near = worst.withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))).where(F.col("near") <= top)
    words = found.where(F.size("ids") == 1).select(F.col("ids")[0].alias("id"), F.col("word").cast("string").alias("word"))
    spelt = near.select("lang", "ids", "a", "l", "r", "n", "score", F.posexplode("ids").alias("at", "id")).join(words, "id")
    spelt = spelt.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
