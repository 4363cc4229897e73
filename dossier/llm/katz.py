"""Language-model scores by Katz backoff.

P(w | h) = d(c(hw)) * c(hw) / c(h) where the pair was seen, else alpha(h) * P(w); P(w) is the unigram
model, discounted alike, whose left-over mass goes to the one type of unknown words.  Discounts are
Good-Turing's for counts up to K.  alpha(h) makes the probabilities of a context sum to exactly 1: the
mass that its seen pairs leave, over the unigram mass of the words that were not seen after it.

Counts are tables partitioned by word and by context.  Documents are dealt into batches of a few MB;
a batch asks the word tables for its distinct words, then the pair tables for its distinct pairs and
contexts, and scores its tokens with the replies.  Asking is how counts are gathered too: the requests
carry the batch's own training counts, and a table answers once it has them all.  So there is one
shuffle of the texts, no row per token, and nothing global but some twenty numbers (counts of counts).
A frequent context's pairs are spread over as many partitions as its count asks for; their sums for
the context are added up by the batch.

Defined cases: a null or empty text has the end token only; without training tokens every token is
unknown and has probability 1; a context none of whose pairs is rare leaves one count's mass; repeated
rows are tokens again; ids may be null (as the empty text) and need not be unique.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas import types as arrow_types

from dossier.llm._text import LOWER, SPACE, U64, mix, planes, string_buffers, whole, word_hashes, word_spans

#: Counts up to K are discounted; bytes of text in a batch and in a task; count of a context for each partition of its pairs.
K, BATCH_BYTES, TASK_BYTES, SPREAD = 5, 6 << 20, 64 << 20, 500_000
_END, _BOS, _UNKNOWN = U64(1), U64(0), (1 << 40) - 1
_ROW = "_b long, _k byte, _p int, _x binary, _y binary"


class Batch:
    """The tokens of some documents.  Everything here follows from the texts alone, whatever their order."""

    def __init__(self, table: pa.Table, parts: int):
        self.train = table["_train"].combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        buf, offs = string_buffers(table["_text"])
        hashes, docs, last = [], [], 0
        for lo in range(0, len(offs) - 1, 256):
            hi = min(lo + 256, len(offs) - 1)
            piece = LOWER[buf[offs[lo] : offs[hi]]]
            starts, ends, first = word_spans(piece, offs[lo : hi + 1] - offs[lo], SPACE)
            h = word_hashes(piece, starts, ends)
            hashes.append(np.insert(np.where(h < 16, h + U64(16), h), first[1:], _END))
            docs.append(np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(first) + 1))
        token = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.begin = np.ones(len(token), bool)
        self.begin[1:] = self.doc[1:] != self.doc[:-1]
        self.words, inverse = np.unique(token, return_inverse=True)
        self.token = inverse.astype(np.int32)
        self.use = self.train[self.doc] if len(token) else np.zeros(0, bool)
        self.part = (mix(self.words) % U64(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")

    def word_requests(self):
        """(part, hashes, training counts), part after part."""
        count = np.bincount(self.token[self.use], minlength=len(self.words))
        for p, at in _split(self.part[self.order], self.order):
            yield p, self.words[at].tobytes(), planes(count[at])

    def read_words(self, rows) -> None:
        """Takes the word tables' replies: each word's id (0 is the start of a text) and count."""
        self.id, self.count = np.full(len(self.words), _UNKNOWN, np.int64), np.zeros(len(self.words), np.int64)
        at = 0
        for x, y in rows:
            ids = whole(x)
            own = self.order[at : at + len(ids)]
            self.id[own], self.count[own] = ids, whole(y)
            at += len(ids)
        assert at == len(self.words), "a word table did not answer"

    def pair_keys(self, parts: int, starts: int):
        """Distinct known pairs and contexts, in the order in which they are asked for."""
        token = self.token
        context = np.full(len(token), -1, np.int32)
        context[1:] = token[:-1]
        context[self.begin] = -1
        wide = len(self.words) + 1
        known = np.append(self.count > 0, starts > 0)  # at -1: the start
        ok = known[context] & known[token]
        key, inverse = np.unique((context[ok].astype(np.int64) + 1) * wide + token[ok], return_inverse=True)
        self.pair = np.full(len(token), -1, np.int32)
        self.pair[ok] = inverse
        train = np.bincount(inverse, self.use[ok], len(key)).astype(np.int64)
        ctx, fol = key // wide - 1, key % wide
        ids, counts = np.append(self.id, 0), np.append(self.count, starts)
        spread = np.maximum(1, -(-counts // SPREAD))
        # Contexts: each in all its partitions.
        own = np.unique(context[known[context]])
        c = np.repeat(own, spread[own])
        s = np.concatenate([np.arange(k) for k in spread[own].tolist()]) if len(own) else np.zeros(0, np.int64)
        c_key = ids[c] | s << 40
        c_part = (mix(c_key.astype(U64)) % U64(parts)).astype(np.int64)
        c_order = np.lexsort((c_key, c_part))
        f_s = (mix(ids[fol].astype(U64)) % spread[ctx].astype(U64)).astype(np.int64)
        f_key = ids[ctx] | f_s << 40
        f_part = (mix(f_key.astype(U64)) % U64(parts)).astype(np.int64)
        f_order = np.lexsort((ids[fol], f_key, f_part))
        self.context = context
        return (c, c_key, c_part, c_order), (fol, f_key, f_part, f_order, train)

    def pair_requests(self, parts: int, starts: int):
        (c, c_key, c_part, c_order), (fol, f_key, f_part, f_order, train) = self.pair_keys(parts, starts)
        by = {p: at for p, at in _split(f_part[f_order], f_order)}
        for p, at in _split(c_part[c_order], c_order):
            f = by.get(p, np.zeros(0, np.int64))
            # How many of the pairs belong to each context, both in ascending order of its key.
            n = np.bincount(np.searchsorted(c_key[at], f_key[f]), minlength=len(at))
            yield p, planes(c_key[at], 8) + planes(n, 4), planes(self.id[fol[f]]) + planes(train[f]) + planes(self.count[fol[f]])

    def read_pairs(self, rows, parts: int, starts: int) -> None:
        (c, c_key, c_part, c_order), (fol, _, f_part, f_order, _) = self.pair_keys(parts, starts)
        rows = list(rows)
        counts = np.concatenate([whole(x) for x, _ in rows]) if rows else np.zeros(0, np.int64)
        stats = np.concatenate([whole(y).reshape(2 * K + 1, -1) for _, y in rows], axis=1) if rows else np.zeros((2 * K + 1, 0), np.int64)
        assert len(counts) == len(fol) and stats.shape[1] == len(c), "a pair table did not answer"
        self.pair_count = np.zeros(len(fol), np.int64)
        self.pair_count[f_order] = counts
        self.stats = np.zeros((2 * K + 1, len(self.words) + 1))  # the last: the start of a text
        for k in range(2 * K + 1):
            np.add.at(self.stats[k], c[c_order], stats[k])


def _split(sorted_keys: np.ndarray, at: np.ndarray):
    if len(at):
        cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(sorted_keys[a]), at[a:b]


def discounts(n: list[float]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 .. K from the numbers of types seen 1 .. K + 1 times.

    Where those are too few to tell (none of a count, or a factor outside 0 .. 1): (r - 0.5) / r."""
    out = np.ones(K + 1)
    for r in range(1, K + 1):
        out[r] = (r - 0.5) / r
        if n[0] > 0 and n[r - 1] > 0:
            common = (K + 1) * n[K] / n[0]
            if common < 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return out


class Model:
    """The global numbers: N, V, types by count (words, pairs)."""

    def __init__(self, numbers: list[float]):
        self.N, self.V = numbers[0], numbers[1]
        self.d1, self.d2 = discounts(numbers[2 : 3 + K]), discounts(numbers[3 + K : 4 + 2 * K])
        lost = sum((1 - self.d1[r]) * r * numbers[1 + r] for r in range(1, K + 1))
        self.scale1 = 1.0
        if self.N and lost <= 0:  # no rare word: one count's mass is left
            self.scale1, lost = self.N / (self.N + 1), self.N / (self.N + 1)
        self.unknown = lost / self.N if self.N else 1.0

    def unigram(self, count: np.ndarray) -> np.ndarray:
        d = self.d1[np.minimum(count, K)]
        d = np.where(count > K, 1.0, d)
        return np.where(count > 0, self.scale1 * d * count / max(1, self.N), self.unknown)

    def contexts(self, stats: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factor of the seen pairs' discounted shares, and alpha, of each context.

        stats: pairs seen 1 .. K times; the followers' counts summed; followers by word count 1 .. K."""
        r = np.arange(1, K + 1)[:, None]
        left = ((1 - self.d2[1:, None]) * r * stats[:K]).sum(0) / np.maximum(1, count)
        scale = np.where((left > 0) | (count == 0), 1.0, count / (count + 1.0))
        left = np.where(left > 0, left, 1.0 / (count + 1.0))
        seen = self.scale1 * (stats[K] - ((1 - self.d1[1:, None]) * r * stats[K + 1 :]).sum(0)) / max(1, self.N)
        alpha = np.where(count > 0, left / np.maximum(1e-300, 1 - seen), 1.0)
        return scale, alpha

    def token_probabilities(self, b: Batch, starts: int) -> np.ndarray:
        counts = np.append(b.count, starts)
        scale, alpha = self.contexts(b.stats, counts)
        ctx = b.context
        pair = np.where(b.pair >= 0, np.append(b.pair_count, 0)[b.pair], 0)
        d = np.where(pair > K, 1.0, self.d2[np.minimum(pair, K)])
        seen = scale[ctx] * d * pair / np.maximum(1, counts[ctx])
        return np.where(pair > 0, seen, alpha[ctx] * self.unigram(b.count[b.token]))


def _rows(rows) -> pa.Table:
    kinds = [pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["_b", "_k", "_p", "_x", "_y"])


def _parts_of(table: pa.Table, kind: int):
    t = table.filter(pc.equal(table["_k"], kind)).sort_by("_p")
    return zip(t["_x"].to_pylist(), t["_y"].to_pylist())


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, _train, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    facts = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.when(train, 1)).alias("s")).first()
    # Partitions follow the bytes, so that no table grows with the corpus.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((facts["b"] or 0) / TASK_BYTES))
    batches, starts = max(math.ceil(n / 2), math.ceil((facts["b"] or 0) / BATCH_BYTES)), facts["s"]
    words_p, pairs_p = n, 4 * n
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_key", "_text"), F.lit(batches)).cast("long")).repartition(n, "_b")

    def ask_words(table: pa.Table) -> pa.Table:
        b = table["_b"][0].as_py()
        return _rows([(b, 0, p, x, y) for p, x, y in Batch(table, words_p).word_requests()])

    def answer_words(table: pa.Table) -> pa.Table:
        p = table["_p"][0].as_py()
        hashes = [np.frombuffer(x, U64) for x in table["_x"].to_pylist()]
        counts = [whole(y) for y in table["_y"].to_pylist()]
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(words)).astype(np.int64)
        # Frequent words have small ids.
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        ids = np.where(total > 0, rank * words_p + p + 1, _UNKNOWN)
        out, at = [], 0
        for b, h in zip(table["_b"].to_pylist(), hashes):
            own = inverse[at : at + len(h)]
            out.append((b, 0, p, planes(ids[own]), planes(total[own])))
            at += len(h)
        by = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
        out.append((-1, 0, p, np.array([total.sum(), (total > 0).sum(), *by], np.int64).tobytes(), b""))
        return _rows(out)

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([])
        b = Batch(left, words_p)
        b.read_words(_parts_of(right, 0))
        at = left["_b"][0].as_py()
        return _rows([(at, 1, p, x, y) for p, x, y in b.pair_requests(pairs_p, starts)])

    def answer_pairs(table: pa.Table) -> pa.Table:
        p = table["_p"][0].as_py()
        ctx, fol, cnt, cw, cs = [], [], [], [], []
        for x, y in zip(table["_x"].to_pylist(), table["_y"].to_pylist()):
            m = len(x) // 12
            c, k = whole(x[: 8 * m], 8), whole(x[8 * m :], 4)
            m = len(y) // 15
            cs.append(c), ctx.append(np.repeat(c, k))
            fol.append(whole(y[: 5 * m])), cnt.append(whole(y[5 * m : 10 * m])), cw.append(whole(y[10 * m :]))
        keys, c_of = np.unique(np.concatenate(cs), return_inverse=True)
        sizes, c_sizes = [len(f) for f in fol], [len(c) for c in cs]
        ctx, fol, cnt, cw = map(np.concatenate, (ctx, fol, cnt, cw))
        pair = np.searchsorted(keys, ctx).astype(np.int64) << 40 | fol
        pairs, lead, inverse = np.unique(pair, return_index=True, return_inverse=True)
        total = np.bincount(inverse, cnt, len(pairs)).astype(np.int64)
        seen = total > 0
        owner, count, word = (pairs >> 40)[seen], total[seen], cw[lead][seen]
        m = len(keys)
        stats = [np.bincount(owner[count == r], minlength=m) for r in range(1, K + 1)]
        stats.append(np.bincount(owner, word, m).astype(np.int64))
        stats += [np.bincount(owner[word == r], minlength=m) for r in range(1, K + 1)]
        stats = np.stack(stats)
        out, at, c_at = [], 0, 0
        for b, k, c in zip(table["_b"].to_pylist(), sizes, c_sizes):
            out.append((b, 1, p, planes(total[inverse[at : at + k]]), planes(stats[:, c_of[c_at : c_at + c]].ravel())))
            at, c_at = at + k, c_at + c
        by = np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]
        out.append((-1, 1, p, np.array(by, np.int64).tobytes(), b""))
        return _rows(out)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_key", "_train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        numbers = left["_numbers"][0].as_py()
        model = Model(numbers)
        b = Batch(left, words_p)
        b.read_words(_parts_of(right, 0))
        b.read_pairs(_parts_of(right, 1), pairs_p, starts)
        count = b.count[b.token]
        rows = left.num_rows
        base = np.log10((count + 0.5) / (model.N + 0.5 * (model.V + 1)))
        own = np.log10(model.token_probabilities(b, starts))
        total = lambda w: np.bincount(b.doc, w, rows)
        return pa.table([left["_key"], left["_train"], pa.array(np.bincount(b.doc, minlength=rows)), pa.array(total(count > 0).astype(np.int64)), pa.array(np.full(rows, int(model.N))), pa.array(total(base)), pa.array(total(own))], names=names)

    kind = arrow_types.to_arrow_type(rows.schema["_key"].dataType)
    words = dealt.groupBy("_b").applyInArrow(ask_words, _ROW).repartition(n, "_p").groupBy("_p").applyInArrow(answer_words, _ROW)
    by_batch = words.where("_b >= 0")
    pairs = dealt.groupBy("_b").cogroup(by_batch.repartition(n, "_b").groupBy("_b")).applyInArrow(ask_pairs, _ROW).repartition(n, "_p").groupBy("_p").applyInArrow(answer_pairs, _ROW)
    # One row of numbers, added up from a line of each partition.
    lines = words.where("_b < 0").unionByName(pairs.where("_b < 0"))
    numbers = lines.select("_k", F.posexplode(_longs("_x"))).groupBy("_k", "pos").agg(F.sum("col").alias("c")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "pos", "c"))), lambda x: x["c"].cast("double")).alias("_numbers"))
    filled = F.when(F.size("_numbers") == 4 + 2 * K, F.col("_numbers")).otherwise(F.array_repeat(F.lit(0.0), 4 + 2 * K))
    numbers = numbers.select(filled.alias("_numbers"), F.lit(1).alias("_one"))
    left = dealt.withColumn("_one", F.lit(1)).join(F.broadcast(numbers), "_one").drop("_one")  # one row
    replies = by_batch.unionByName(pairs.where("_b >= 0"))
    out = left.groupBy("_b").cogroup(replies.repartition(n, "_b").groupBy("_b")).applyInArrow(evaluate, f"_key {rows.schema['_key'].dataType.simpleString()}, _train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_key", key)


def _longs(column: str) -> Column:
    """A binary column of little-endian 64-bit integers as an array of longs."""
    hexed = F.hex(column)
    n = (F.length(hexed) / 16).cast("int")

    def one(i: Column) -> Column:
        chunk = hexed.substr(i * 16 + 1, F.lit(16))
        turned = F.concat(*[chunk.substr(F.lit(k), F.lit(2)) for k in range(15, 0, -2)])
        return F.conv(turned, 16, 10).cast("long")

    return F.transform(F.sequence(F.lit(0), n - 1), one)
