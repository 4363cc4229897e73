"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of the words it
holds, less what the bias alone would give, so that a sentence without known words adds nothing and no
text becomes toxic by its length; the document's is their noisy-or, 1 - prod(1 - p).  Weights are
learnt from document labels alone (the gradient of the noisy-or tells which sentences are to blame),
and then point at the sentences of any document.

The classifier is fitted on at most TRAIN_ROWS labelled documents of any length, picked by a hash of
their id.  Executors read their texts, twice: they count words, then send the driver how often each
combination of known words stands in a sentence of a document.  Known are the words that stand in
MIN_DOCS of the documents, and in toxic ones above chance.  Scoring reads every whole text and shuffles nothing.

Defined cases: a null or empty text has no sentence and scores 0; with no labels, or labels of one
class, every score is 0 or 1 accordingly with no words (0 without labels); conflicting labels of one
document count as toxic; of an id with several texts one is learnt from (the least by hash); repeated rows
score alike; an empty table gives no rows; a very long text is scored whole; other columns pass through, but
for those with the names of the output, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm._pack import pack, unpack
from dossier.llm._text import BYTE_CODE, LOWER, NON_ALNUM, U64, Members, prefix_sums, row_groups, span_hashes, string_buffers, word_spans

TRAIN_ROWS, MIN_DOCS, SURPRISE = 6000, 3, 4.0
#: The fit's probability that a document is toxic by none of its known words.
LEAK = 0.01
STEMS = (4, 5, 6)
#: A sentence ends at one of . ! ? or a line's end.
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds, is fold (a null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold


def _sentences(buf: np.ndarray, offs: np.ndarray):
    """Features (hash, and which word has it); per word: sentence (numbered through the piece), row, start, end.

    A word has itself and its first 4, 5 and 6 bytes as features, so that the forms of one stem are learnt together."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs, NON_ALNUM)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    mark = stops[starts] + row  # another row begins another sentence
    sentence = np.cumsum(np.concatenate([[0], (np.diff(mark) > 0) | (np.diff(row) > 0)])) if len(starts) else np.zeros(0, np.int64)
    hashes, owner = [], []
    if len(starts):
        sums = prefix_sums(BYTE_CODE[low])
        hashes.append(span_hashes(sums, starts, ends))
        owner.append(np.arange(len(starts)))
        for n in STEMS:
            at = np.flatnonzero(ends - starts > n)
            hashes.append(span_hashes(sums, starts[at], starts[at] + n) ^ U64(0x5851F42D4C957F2D * n & 0xFFFFFFFFFFFFFFFF))
            owner.append(at)
    joined = (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.zeros(0, U64), np.zeros(0, np.int64))
    return *joined, sentence[: len(starts)], row, starts, ends


class Model:
    """Known word hashes (sorted), their weights, and the bias; without words the bias alone decides."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias, self.members = words, weights, bias, None
        self.background = 1 / (1 + np.exp(-bias)) if len(words) else 0.0

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known features stand, and their weights."""
        if self.members is None:
            self.members = Members(self.words)
        at = self.members.where(hashes)
        return at, self.weights[np.searchsorted(self.words, hashes[at])]

    def score(self, hashes: np.ndarray, owner: np.ndarray, sentence: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's noisy-or, and each sentence's probability.  A feature counts once in a sentence."""
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        at, weight = self.of(hashes)
        cell, once = np.unique(sentence[owner[at]] * np.int64(max(1, len(self.words))) + np.searchsorted(self.words, hashes[at]), return_index=True)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(cell // max(1, len(self.words)), weight[once], n) + self.bias, -30, 30)))
        p = np.maximum(0, (p - self.background) / (1 - self.background))
        owner = np.zeros(n, np.int64)
        owner[sentence] = row
        return 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), rows)[:rows]), p


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", rounds: int = 150) -> Model:
    """Fits the weights on a bounded sample of the rows of `labels` for which `use` holds."""
    spark = docs.sparkSession
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    wanted = wanted if use is None else wanted.where(use)
    picked = wanted.groupBy(key).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS).collect()
    if not picked:
        return Model(np.zeros(0, U64), np.zeros(0), -30.0)
    kind = dict(labels.dtypes)[key]
    chosen = spark.createDataFrame([(r[key], r["_y"]) for r in picked], f"_key {kind}, _y int")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # TRAIN_ROWS ids
    rows = rows.groupBy("_key", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))  # one text an id, however often it stands there
    by = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(by) < 2:
        return Model(np.zeros(0, U64), np.zeros(0), 30.0 if 1 in by else -30.0)
    n = sum(by.values())
    words = _vocabulary(rows, n, by[1] / n)
    y, owner, times, s, f = _cells(rows, words)
    w, b = fit(y, owner, times, s, f, len(words), n, rounds)
    keep = w > 0.05
    return Model(words[keep], w[keep], b) if keep.any() else Model(np.zeros(0, U64), np.zeros(0), -30.0)


def _vocabulary(rows: DataFrame, n: int, base: float) -> np.ndarray:
    """Hashes of the words that stand in toxic documents clearly more often than the base rate lets expect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column("_text"))
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
            for lo, hi in row_groups(offs):
                h, w, _, r, _, _ = _sentences(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                words, index = np.unique(h, return_inverse=True)
                pairs = np.unique(index * (hi - lo) + r[w])
                index, doc = pairs // (hi - lo), pairs % (hi - lo)
                count = [np.bincount(index, x, len(words)).astype(np.int64) for x in (None, y[lo:hi][doc])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words.view(np.int64), *count)], names=["hash", "docs", "toxic"])

    counts = rows.select("_y", "_text").mapInArrow(run, "hash long, docs long, toxic long").groupBy("hash").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    known = (F.col("docs") >= MIN_DOCS) & (F.col("toxic") - F.col("docs") * base > SURPRISE * F.sqrt(F.col("docs") * (base * (1 - base)) + 1e-9))
    found = counts.where(known).select("hash").toArrow().column("hash")
    return np.sort(found.to_numpy().astype(np.int64).view(U64))


def _cells(rows: DataFrame, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Label of each document with known words; document and number of its sentences for each combination; combination and word of each cell."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    mark = np.random.default_rng(1).integers(0, 1 << 63, len(words), np.uint64)  # a combination's sum of marks tells it from others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        members = Members(words)
        for batch in batches:
            buf, offs = string_buffers(batch.column("_text"))
            for lo, hi in row_groups(offs):
                h, w, sentence, r, _, _ = _sentences(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at = members.where(h)
                if not len(at):
                    continue
                # A word counts once in a sentence.
                cells = np.unique(sentence[w[at]] * np.int64(len(words)) + np.searchsorted(words, h[at]))
                s, f = cells // len(words), cells % len(words)
                first = np.flatnonzero(np.concatenate([[True], np.diff(s) > 0]))
                size = np.diff(np.append(first, len(s)))
                row = r[np.searchsorted(sentence, s[first])]
                both = np.rec.fromarrays([row, np.add.reduceat(mark[f], first)])
                _, one, times = np.unique(both, return_index=True, return_counts=True)
                docs, begin = np.unique(row[one], return_index=True)
                for doc, i, j in zip(docs.tolist(), begin.tolist(), [*begin[1:].tolist(), len(one)]):
                    own = one[i:j]
                    values = [times[i:j], size[own], np.concatenate([f[first[k] : first[k] + size[k]] for k in own.tolist()])]
                    head = [batch.column(c).slice(lo + doc, 1) for c in ("_key", "_y", "_hash")]
                    lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in values]
                    yield pa.RecordBatch.from_arrays([*head, *lists], names=["_key", "_y", "_hash", "times", "size", "word"])

    kind = dict(rows.dtypes)["_key"]
    schema = f"_key {kind}, _y int, _hash long, times array<long>, size array<long>, word array<long>"
    out = rows.withColumn("_hash", F.xxhash64("_text")).mapInArrow(run, schema).toArrow().sort_by([("_key", "ascending"), ("_hash", "ascending")])
    flat = lambda c: out.column(c).combine_chunks().flatten().to_numpy()
    times, size, word = (flat(c) if out.num_rows else np.zeros(0, np.int64) for c in ("times", "size", "word"))
    counts = np.array([len(x) for x in out.column("times").to_pylist()], np.int64)
    return np.array(out.column("_y").to_pylist(), float), np.repeat(np.arange(out.num_rows), counts), times, np.repeat(np.arange(len(size)), size), word


def fit(y: np.ndarray, owner: np.ndarray, times: np.ndarray, s: np.ndarray, f: np.ndarray, words: int, n: int, rounds: int, evidence: float = 0.7, step: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the log likelihood of n document labels under the noisy-or (those not in y have no known word).

    Weights are not negative (a word can accuse a sentence, none excuses it), and an L1 penalty worth
    `evidence` documents keeps words out that stand in toxic documents by chance."""
    w, b = np.zeros(words), -5.0
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(s, w[f], len(owner)) + b, -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.log1p(-LEAK) + np.bincount(owner, times * (np.logaddexp(0, b) - np.logaddexp(0, z)), len(y))  # log of prod(1 - p)
        toxic = -np.expm1(clean)
        # d log L / dz: -p for clean documents, p * (1 - P) / P for toxic ones.
        g = times * np.where(y[owner] > 0, np.exp(clean[owner]) / toxic[owner], -1)
        grad = np.append(np.bincount(f, (g * p)[s], words) - evidence, (g * (p - p0)).sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = step * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = np.maximum(0, w + move[:-1]), b + move[-1]
    return w, float(b)


def toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score", sentences: str | None = "toxic_sentences", at_least: float = 0.5) -> DataFrame:
    """docs plus the score and the sentences of that probability (byte offsets of their words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the known words of TRAIN_ROWS documents
    names = [score, *([sentences] if sentences else [])]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), *([T.StructField(sentences, _SPANS)] if sentences else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, offs = string_buffers(batch.column(text))
            scores, spans = [], []
            for lo, hi in row_groups(offs):
                h, w, s, r, starts, ends = _sentences(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                total, p = model.score(h, w, s, r, hi - lo)
                scores.append(np.clip(total, 0, 1))
                found = [[] for _ in range(hi - lo)]
                bad = np.flatnonzero(p >= at_least)
                left, right = np.searchsorted(s, bad, "left"), np.searchsorted(s, bad, "right") - 1
                for k, i, j in zip(bad.tolist(), left.tolist(), right.tolist()):
                    at = int(offs[lo + r[i]] - offs[lo])
                    found[r[i]].append({"start": int(starts[i]) - at, "end": int(ends[j]) - at, "p": float(p[k])})
                spans += found
            columns = [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            if sentences:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    model = train(docs, labels, ~held_out(key), key, text)
    scored = toxicity(pack(docs, _text=text), model, "_text", "_score", None)
    return unpack(scored.where(F.col("_score") < threshold), docs, _text=text)
