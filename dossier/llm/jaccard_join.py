"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct word shingles.  Two documents link if the Jaccard similarity of
their sets reaches the threshold.  The result is each document's component: no pair is listed.

1. Groups.  Shingles are ordered by rarity: how many sets of the whole corpus hold them (counted in
   tables partitioned by shingle, which batches of documents ask and fill at once).  Two sets that
   reach the threshold share one of their rarest n - ceil(t * n) + 1 shingles each, so those are the
   only ones worth comparing, and of them only the ones that more than one set holds: its tokens.
   Most documents have none and are done.  A token's leader is the least set that holds it; a group is
   a leader and every set that shares a token with it which it leads.  Two sets with a common token are
   both in the group of its leader, so no link is missed, and groups are not closed over further ones:
   a group is as large as the lists of one set's tokens, however the corpus hangs together.  Copies
   have the same leaders for most of their tokens, so a set travels to few groups.
2. Search.  Inside a group, sets are searched with DivideSkip, the leader first: of the inverted lists
   of a query's shingles the short ones are merged with a heap, and documents with enough occurrences
   are probed for by binary search in the long ones.  A set that has joined a component is not searched
   for again, so a group of copies costs about one query.  A group of more than BLOCK sets goes in
   chunks: the leader is searched for in each, then what is not similar to it, in chunk pairs, which
   bounds memory and drops nothing.
3. Components of the links found.

Defined cases: a document without words has an empty set and links with nothing, not even with another
such; with fewer words than a shingle its whole word sequence is its only shingle; equal sets are one
class from the start; ids may be null or repeated, but are whole numbers (others raise TypeError); an empty
table gives no rows; a very long text is taken whole; other columns pass through keep_one whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm._components import components
from dossier.llm._cut import checkpointed, release
from dossier.llm._pack import pack, unpack
from dossier.llm._repeats import KEY, keyed
from dossier.llm._text import LOWER, SPACE, U64, binary_column, gram_hashes, mix, planes, prefix_sums, ragged, row_groups, span_hashes, string_buffers, whole, word_hashes, word_spans

#: Sets of a group that are searched in one task; bytes of text whose shingles are counted at once, and in one task.
BLOCK, BATCH_BYTES, TASK_BYTES = 4000, 4 << 20, 64 << 20
#: Keys over which a token's list of sets, and the documents of a set or of a component, are dealt; and the sets of a
#: group of more than BLOCK, of which there are few.
SALTS, GROUP_SALTS = 8, 64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs, SPACE)
    words = word_hashes(buf, starts, ends)
    sums = prefix_sums(words)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(words))
    full = at + n <= first[1:][row]
    h = gram_hashes(sums, n)
    row_of, hash_of = row[full], h[at[full]]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        row_of = np.concatenate([row_of, short])
        hash_of = np.concatenate([hash_of, span_hashes(sums, first[short], first[short + 1])])
    order = np.lexsort((hash_of, row_of))
    row_of, hash_of = row_of[order], hash_of[order]
    new = np.ones(len(row_of), bool)
    new[1:] = (row_of[1:] != row_of[:-1]) | (hash_of[1:] != hash_of[:-1])
    return row_of[new], hash_of[new]


def set_digests(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and digest of each row's set (0, 0: empty)."""
    size = np.bincount(row, minlength=rows)
    digest = np.zeros(rows, U64)
    some = np.flatnonzero(size)
    if len(some):
        digest[some] = mix(np.add.reduceat(mix(h ^ U64(0x2545F4914F6CDD1D)), (np.cumsum(size) - size)[some]) + size[some].astype(U64))
    return size, digest


def _batch_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the shingles of a batch's distinct sets, and each row's set size and digest."""
    buf, offs = string_buffers(column)
    rows, hashes, sizes, digests = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for lo, hi in row_groups(offs):
        row, h = shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
        size, digest = set_digests(row, h, hi - lo)
        rows.append(row + lo), hashes.append(h), sizes.append(size), digests.append(digest)
    row, h, size, digest = map(np.concatenate, (rows, hashes, sizes, digests))
    fresh = np.zeros(len(size), bool)
    fresh[np.unique(digest, return_index=True)[1]] = True
    keep = (fresh & (size > 0))[row]
    return row[keep], h[keep], size, digest


def _rarity_keys(h: np.ndarray, width: int) -> np.ndarray:
    """What a shingle is counted under: its partition and 40 bits of its hash."""
    return ((h >> U64(40)) % U64(width)) << U64(40) | (h & U64((1 << 40) - 1))


_ROW = "_b long, _p int, _x binary, _y binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["_b", "_p", "_x", "_y"])


def _suspects(docs: DataFrame, text: str, n: int, t: Fraction) -> DataFrame:
    """_d, _v, _n (set size), _a (set digest) of every document, and for suspects _set and _tokens (else empty).

    A suspect's set holds, among its rarest shingles, some that other sets hold too: its tokens.  Of equal
    sets of a batch the first row has them."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    # Partitions follow the bytes, so that no task and no table grows with the corpus.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    batches = max(parts, -(-size // BATCH_BYTES))
    width = 4 * parts  # tables of shingles: each is counted in memory
    dealt = docs.select("_d", "_v", text).withColumn("_b", F.pmod(F.xxhash64("_d", "_v"), F.lit(batches)).cast("long")).repartition(parts, "_b")

    def ask(table: pa.Table) -> pa.Table:
        _, h, _, _ = _batch_sets(table[text].combine_chunks(), n)
        key, count = np.unique(_rarity_keys(h, width), return_counts=True)
        part = (key >> U64(40)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        at = table["_b"][0].as_py()
        return _table([(at, int(part[i]), planes(key[i:j] & U64((1 << 40) - 1)), planes(np.minimum(count[i:j], 255), 1)) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())])

    def answer(table: pa.Table) -> pa.Table:
        p, asked = table["_p"][0].as_py(), table["_b"].to_pylist()
        keys, counts = [whole(x) for x in table["_x"].to_pylist()], [whole(x, 1) for x in table["_y"].to_pylist()]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(inverse, np.concatenate(counts), len(every)), 255).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        return _table([(b, p, planes(total[inverse[cut[i] : cut[i + 1]]], 1), b"") for i, b in enumerate(asked)])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["_d", "_v", "_n", "_a", "_set", "_tokens"], [pa.int64()] * 4 + [pa.binary()] * 2
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row, h, size, digest = _batch_sets(left[text].combine_chunks(), n)
        key = _rarity_keys(h, width)
        known = np.unique(key)
        replies = np.concatenate([np.zeros(0, np.int64), *(whole(x, 1) for x in right.sort_by("_p")["_x"].to_pylist())])
        assert len(replies) == len(known), "a table of shingles did not answer"
        holders = replies[np.searchsorted(known, key)]
        order = np.lexsort((h, key, holders, row))
        first = np.searchsorted(row, np.arange(len(size)))
        place = np.arange(len(h)) - first[row[order]]
        prefix = size - -(-size * t.numerator // t.denominator) + 1
        own = row[order]
        use = (place < prefix[own]) & (holders[order] > 1)
        chosen = np.bincount(own[use], minlength=len(size))
        member = chosen[row] > 0
        lists = [binary_column(h[member], np.where(chosen > 0, size, 0) * 8), binary_column(h[order][use], chosen * 8)]
        return pa.table([left["_d"], left["_v"], pa.array(size), pa.array(digest.view(np.int64)), *lists], names=names)

    replies = dealt.groupBy("_b").applyInArrow(ask, _ROW).repartition(parts, "_p").groupBy("_p").applyInArrow(answer, _ROW)
    return dealt.groupBy("_b").cogroup(replies.repartition(parts, "_b").groupBy("_b")).applyInArrow(choose, "_d long, _v long, _n long, _a long, _set binary, _tokens binary")


def _groups(suspects: DataFrame) -> DataFrame:
    """_a, _block: the sets of every leader's group, the leader too.  suspects: _a, _tokens."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_buffers(batch.column("_tokens").cast(pa.large_binary()))
            token = np.ascontiguousarray(data).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), batch.column("_a").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offs) // 8)))], names=["_w", "_a"])

    held = suspects.select("_a", "_tokens").mapInArrow(deal, "_w long, _a long")
    leaders = held.groupBy("_w").agg(F.min("_a").alias("_block"), F.max("_a").alias("_last")).where("_last > _block")
    # A token may be in a third of all sets: its list is dealt over SALTS keys, each with its own row of the leader.
    leaders = _dealt(leaders.select("_w", "_block"))
    salted = held.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(SALTS)).cast("int"))
    return salted.join(leaders, ["_w", "_salt"]).select("_a", "_block").distinct()


class Lists:
    """Inverted lists of a block's sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.size = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(self.n), self.size)
        self.words, number = np.unique(token, return_inverse=True)
        key = number.astype(np.int64) * self.n + owner
        self.key = np.sort(key)  # list after list, ascending documents
        self.begin = np.searchsorted(self.key, np.arange(len(self.words) + 1) * self.n)
        self.first = np.cumsum(self.size) - self.size
        self.number = number

    def search(self, q: int, open_: np.ndarray, t: Fraction) -> np.ndarray:
        """Documents marked in open_ whose Jaccard similarity to q reaches t."""
        size = int(self.size[q])
        fits = open_ & (self.size * t.denominator >= size * t.numerator) & (size * t.denominator >= self.size * t.numerator)
        if not fits.any():
            return np.zeros(0, np.int64)
        smallest = int(self.size[fits].min())
        # Overlap that a partner of the smallest size needs: I >= t / (1 + t) * (|A| + |B|).
        need = lambda total: -(-total * t.numerator // (t.numerator + t.denominator))
        T = int(need(size + smallest))
        tokens = self.number[self.first[q] : self.first[q] + size]
        length = self.begin[tokens + 1] - self.begin[tokens]
        order = np.argsort(length, kind="stable")
        tokens, length = tokens[order], length[order]
        # DivideSkip: L long lists are only probed.  The more they cost to merge, the more are set aside.
        L = min(T - 1, len(tokens) - 1, int(T / (0.0085 * np.log2(max(2, int(length[-1]))) + 1)))
        short, long = tokens[: len(tokens) - L], tokens[len(tokens) - L :]
        found, count = self._merge(short, fits)
        enough = count >= T - L
        found, count = found[enough], count[enough]
        if len(found) and L:
            probe = (long.astype(np.int64) * self.n)[None, :] + found[:, None]
            at = np.searchsorted(self.key, probe)
            count = count + (self.key[np.minimum(at, len(self.key) - 1)] == probe).sum(1)
        total = size + self.size[found]
        return found[count >= np.array([need(int(x)) for x in total], np.int64)]

    def _merge(self, tokens: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents on the lists of `tokens` and how often: a heap merge of the short lists."""
        lists = [(self.key[self.begin[x] : self.begin[x + 1]] - x * self.n).tolist() for x in tokens.tolist()]
        found, count = [], []
        for d, same in groupby(merge(*lists)):
            if fits[d]:
                found.append(d)
                count.append(sum(1 for _ in same))
        return np.array(found, np.int64), np.array(count, np.int64)


def link(sets: list[np.ndarray], t: Fraction) -> np.ndarray:
    """For each set the first of its component."""
    lists = Lists(sets)
    root, open_ = np.arange(lists.n), np.ones(lists.n, bool)
    for seed in range(lists.n):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue and open_.any():
            near = lists.search(queue.pop(), open_, t)
            open_[near] = False
            root[near] = seed
            queue += near.tolist()
    return root


def _against_leader(members: DataFrame, t: Fraction) -> DataFrame:
    """members without the leaders, plus _linked (similar to the leader): the leader is searched for in every chunk."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leads = F.col("_a") == F.col("_block")
    chunk = F.when(leads, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("_a"), "_chunks").cast("int")))
    names = members.columns
    schema = T.StructType([*members.schema.fields, T.StructField("_linked", T.BooleanType())])

    def judged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table["_set"]]
        open_ = np.ones(len(sets), bool)
        open_[0] = False
        linked = np.zeros(len(sets), bool)
        if len(sets) > 1:
            linked[Lists(sets).search(0, open_, t)] = True
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in names), pa.array(linked)], names=schema.names).slice(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("_block", "_chunk")], 1)
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1), [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if tuple(k[lo]) != key and rows:
                    yield judged(rows)
                    rows = []
                key = tuple(k[lo])
                rows.append(batch.slice(lo, hi - lo).select(names))
        if rows:
            yield judged(rows)

    dealt = members.withColumn("_chunk", F.explode(chunk)).repartition(parts, "_block", "_chunk")
    return dealt.sortWithinPartitions("_block", "_chunk", F.when(leads, 0).otherwise(1), "_a").mapInArrow(run, schema)


def _links(members: DataFrame, t: Fraction) -> DataFrame:
    """u, v: links that span the components of each group, checkpointed.  members: _a, _set, _block, _chunks.

    In a group of one chunk the leader is the first query.  In others it is searched for chunk by chunk; what is
    similar to it is one component already and need not be compared with itself.  The rest is searched
    against all, in chunk pairs."""
    whole_blocks = members.where("_chunks = 1").withColumns({"_rest": F.lit(1), "_is_rest": F.lit(True)})
    large = members.where("_chunks > 1")
    if large.isEmpty():
        return checkpointed(_search(whole_blocks, t))
    judged = checkpointed(_against_leader(large, t))
    tied = judged.where("_linked").select(F.col("_a").alias("u"), F.col("_block").alias("v"))
    rest = judged.where("not _linked").groupBy("_block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_rest"))
    left = _of_group(judged, rest, "inner").select("_a", "_set", "_block", "_chunks", "_rest", (~F.col("_linked")).alias("_is_rest"))
    links = checkpointed(tied.unionByName(_search(whole_blocks.unionByName(left), t)))
    release(judged)
    return links


def _search(members: DataFrame, t: Fraction) -> DataFrame:
    """u, v: links found between the rest and all sets of each group.  members: _a, _set, _block, _chunks (of all
    sets), _rest (chunks of the rest), _is_rest."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, block, g, r, is_rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_block", "_chunks", "_rest", "_is_rest"))
            g, r = g.astype(np.int64), r.astype(np.int64)
            digest = mix(a.view(U64))
            own, own_rest = (digest % g.astype(U64)).astype(np.int64), (digest % r.astype(U64)).astype(np.int64)
            # Group (i, j): chunk i of the rest and chunk j of all.  Every set goes to all i with its own j; one of
            # the rest also to all j with its own i.
            every, some = np.arange(len(a)), np.flatnonzero(is_rest)
            t1, i1 = np.repeat(every, r), ragged(np.zeros(len(a), np.int64), r)
            keep = ~(is_rest[t1] & (i1 == own_rest[t1]))
            t2, j2 = np.repeat(some, g[some]), ragged(np.zeros(len(some), np.int64), g[some])
            times = np.concatenate([t1[keep], t2])
            pair = np.concatenate([(i1 * g[t1] + own[t1])[keep], own_rest[t2] * g[t2] + j2])
            for lo in range(0, len(times), 2000):
                s = slice(lo, lo + 2000)
                yield pa.RecordBatch.from_arrays([pa.array(block[times[s]]), pa.array(pair[s]), pa.array(a[times[s]]), batch.column("_set").take(pa.array(times[s]))], names=["_block", "_pair", "_a", "_set"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(a, body):
            # In order of digest, so that a retried task says the same.
            order = sorted(range(len(a)), key=lambda i: a[i])
            root = link([np.frombuffer(body[i], U64) for i in order], t)
            return [(a[order[i]], a[order[r]]) for i, r in enumerate(root.tolist()) if i != r]

        key, a, body, out = None, [], [], []
        for batch in batches:
            for k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k[:2] != key:
                    if len(a) > 1:
                        out += settle(a, body)
                    key, a, body = k[:2], [], []
                a.append(k[2]), body.append(k[3])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])
                out = []
        if len(a) > 1 and (out := settle(a, body)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.mapInArrow(sets, "_block long, _pair long, _a long, _set binary")
    return rows.repartition(parts, "_block", "_pair").sortWithinPartitions("_block", "_pair", "_a").mapInArrow(search, "u long, v long")


def _dealt(once: DataFrame, salts: int = SALTS) -> DataFrame:
    """once for each of the salts, so that rows which join it need not share a task."""
    return once.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _of_group(sets: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """sets (_a, _block) with the facts (a row a _block) of their group."""
    salted = sets.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(GROUP_SALTS)).cast("int"))
    return salted.join(_dealt(facts, GROUP_SALTS), ["_block", "_salt"], how).drop("_salt")


def near_components(docs: DataFrame, threshold: str, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_d, _v, n_shingles, _component (a long; documents with the same are linked; null for an empty set), _salt
    (one of SALTS, so that a component's documents can be dealt) per row of docs."""
    t = Fraction(threshold)
    rows = keyed(docs.select(key, text), key, text)
    found = checkpointed(_suspects(rows, text, shingle, t))  # few documents have a set here
    # A set may be that of a third of all documents, repeated rows too: they are dealt by their place in the files.
    facts = found.select("_d", "_v", "_n", "_a", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"))
    # Batches may hold the same set: one row of it goes on.
    suspects = found.where(F.octet_length("_tokens") > 0).groupBy("_a").agg(F.first("_set").alias("_set"), F.first("_tokens").alias("_tokens"))
    groups = checkpointed(_groups(suspects))
    chunks = checkpointed(groups.groupBy("_block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_chunks")).where("_chunks > 1"))
    chunked = groups.withColumn("_chunks", F.lit(1)) if chunks.isEmpty() else _of_group(groups, chunks, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    links = _links(suspects.select("_a", "_set").join(chunked, "_a"), t)
    release(groups)
    release(chunks)
    roots = _dealt(components(links).select(F.col("node").alias("_a"), F.col("root").alias("_root")))
    release(links)
    # Empty sets have one digest and no component: each row under a key of its own.
    at = F.when(F.col("_n") > 0, F.col("_a")).otherwise(F.xxhash64("_d", "_v"))
    out = facts.withColumn("_at", at).join(roots.withColumnRenamed("_a", "_at"), ["_at", "_salt"], "left")
    return out.select("_d", "_v", F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.coalesce("_root", "_a")).alias("_component"), "_salt")


def jaccard_components(docs: DataFrame, threshold: str = "0.9", shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles long, component_id (the least key of those it is linked with, through others too)."""
    found = near_components(docs, threshold, shingle, key, text)
    real = F.when(F.col("_d") != -(1 << 63), F.col("_d"))
    # A document alone in its component is the least of it: the rest ask.
    least = found.where("_component is not null").groupBy("_component").agg(F.min(real).alias("component_id"), F.count("*").alias("_many"))
    least = _dealt(least.where("_many > 1").select(F.col("_component").alias("_at"), "component_id"))
    # Documents without a set have no component: each under a key of its own, so that they share no task.
    at = F.coalesce(F.col("_component"), F.xxhash64("_d", "_v"))
    out = found.withColumn("_at", at).join(least, ["_at", "_salt"], "left")
    return out.select(real.alias(key), "n_shingles", F.when(F.col("_component").isNull(), real).otherwise(F.coalesce("component_id", real)).alias("component_id"))


def keep_one(docs: DataFrame, threshold: str = "0.8", shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component (the least by key, then by text hash); repeated rows count as copies."""
    names = {"_key": key, "_text": text}
    packed = pack(docs, **names)
    found = near_components(packed, threshold, shingle, "_key", "_text")
    group = F.coalesce(F.col("_component"), F.xxhash64("_d", "_v"))
    stay = found.groupBy(group.alias("_g"), F.col("_component").isNull().alias("_e")).agg(F.min(F.struct("_d", "_v")).alias("_x")).select("_x._d", "_x._v")
    dealt = keyed(packed, "_key", "_text").join(stay.distinct(), KEY)
    # Of rows with the same id and text the least stays, by what else they hold.
    whole_row = F.to_json(F.struct("_row"))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.xxhash64(whole_row), whole_row))
    return unpack(dealt.withColumn("_nth", nth).where("_nth = 1"), docs, **names)
