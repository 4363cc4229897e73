"""Hard negatives by a two-dimensional block matrix product.

Rows are packed into blocks of at most ROWS rows and CELLS components, anchors (a stated query set) into
blocks of about ANCHORS.  Row blocks are dealt over stripes and every stripe is sent all anchor blocks, so
that each pair of blocks meets once, on a grid of keys.  A tile of scores is added up from chunks of WIDTH
dimensions inside the task where its blocks meet, and reduced there at once; no scores of a tile are
shuffled or stored.  The grid is walked twice: first each tile gives its anchors' best positives, which
meet for an anchor and make its windows; then, with the windows beside the anchors, each tile gives the
best negatives of each window.  Only these lines, a bounded number an anchor and tile, are shuffled.

No task holds more than a few blocks.  Scores are exact: components are whole numbers, the product is
done in 64-bit floats where no sum can pass 2**53, else in 64-bit integers.

Defined cases: rows with a null label, a null vector, or a null, NaN or infinite component take no part;
components are held to +-LARGEST after scaling, so that no score of 2000 dimensions can pass 64 bits; a
shorter vector counts as ended by zeros, an empty one as zeros; a null id is no anchor and comes after all
others where scores tie; repeated rows are rows of their own (a copy of the anchor can be its positive),
and a repeated anchor has its windows each time; an id of 2**63 - 1 reads as null; a positive score below zero has an empty window; an empty
table, or one without anchors, gives no rows.  Only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm._cut import checkpointed

#: Rows and anchors of a block, dimensions of a chunk, and the largest component.
ROWS, ANCHORS, WIDTH, LARGEST = 2048, 256, 32, 1 << 26
#: Components of a block, and anchor blocks that one stripe meets at a time.
CELLS, GATHERED = 1 << 21, 64
_BLOCK = "j long, n int, asked int, wide int, ids binary, labels binary, anchors binary, x binary"
_ANCHORS = "i int, n int, ids binary, labels binary, own binary, x binary"
_BEST = "i int, p int, anchor_id long, positive_id long, positive_score long"
#: A null id, after all others.
_NULL = (1 << 63) - 1


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as a double; null where one is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(embedding, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int"))
    return F.when(embedding.isNotNull() & F.coalesce(finite, F.lit(False)), held)


def _ints(column: pa.Array, kind: type = np.int64, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(kind)


def _wide(sizes: np.ndarray) -> int:
    """The longest vector in whole chunks, one at least."""
    return WIDTH * max(1, -(-int(sizes.max(initial=0)) // WIDTH))


def _chunks(lists: pa.ListArray) -> np.ndarray:
    """The vectors as rows of one matrix, ended by zeros to whole chunks (one at least)."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(sizes), _wide(sizes)), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's rows, a line each.  A block's number is its partition's and its own."""
    from pyspark import TaskContext

    at, held, n, wide = TaskContext.get().partitionId() << 32, [], 0, WIDTH

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, labels = _ints(table["id"].combine_chunks(), null=_NULL), _ints(table["label"].combine_chunks())
        x, asked = _chunks(table["v"].combine_chunks()), _ints(table["anchor"].combine_chunks(), np.uint8, False)
        return _lines([(at, len(ids), int(asked.sum()), x.shape[1], ids.tobytes(), labels.tobytes(), asked.tobytes(), x.tobytes())], _BLOCK)

    for batch in batches:
        own = _wide(batch.column("v").value_lengths().to_numpy(zero_copy_only=False))
        while batch.num_rows:
            most = max(1, min(ROWS, CELLS // max(wide, own)))
            if n < most:
                part, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(part)
                n, wide = n + part.num_rows, max(wide, own)
            if n >= most:
                yield block(pa.Table.from_batches(held))
                at, held, n, wide = at + 1, [], 0, WIDTH
    if n:
        yield block(pa.Table.from_batches(held))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _lines(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _longs(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def zigzag(x: np.ndarray) -> bytes:
    """64-bit integers as byte planes, the sign in the lowest bit: the upper planes compress to nothing."""
    z = (x << 1 ^ x >> 63).astype(np.int64)
    return np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T).tobytes()


def unzigzag(raw: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64)


def partial_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if top < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _tile(a: dict, r: dict) -> np.ndarray:
    """Scores of an anchor block's rows and a row block's, chunk by chunk; where one is wider, the other has zeros."""
    x, y = (_longs(b["x"], np.int32).reshape(b["n"], -1) for b in (a, r))
    out = np.zeros((a["n"], r["n"]), np.int64)
    for c in range(0, min(x.shape[1], y.shape[1]), WIDTH):
        out += partial_scores(x[:, c : c + WIDTH], y[:, c : c + WIDTH])
    return out


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: the highest scores, of equal ones the least ids."""
    if len(score) > 4 * k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= bound)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for each anchor and positive.

    anchor: a condition on rows.  label: a column's name, or an expression.  A negative is of another label
    and scores from low to high hundredths of the positive's score."""
    label = F.col(label) if isinstance(label, str) else label
    spark = rows.sparkSession
    used = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(embedding), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    used = used.where("label is not null and v is not null")
    packed = checkpointed(used.mapInArrow(_pack_rows, _BLOCK))  # numbers of blocks and places hold from here on
    facts = packed.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("a"), F.count("*").alias("n"), F.coalesce(F.max("wide"), F.lit(WIDTH)).alias("wide")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, stripes = max(1, math.ceil(facts["a"] / max(1, min(ANCHORS, CELLS // facts["wide"])))), max(1, min(4 * tasks, facts["n"]))
    parts = math.ceil(groups / GATHERED)
    asked = _anchor_blocks(packed, groups)
    grid_rows = packed.select(F.pmod(F.xxhash64("j"), F.lit(stripes)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"), F.struct("j", "n", "ids", "labels", "x").alias("r")).repartition(tasks, "s", "g")

    def met(anchors: DataFrame) -> DataFrame:
        """Each pair of blocks once.  Merged: a table's anchors are no list to broadcast, nor its blocks' tasks to be fewer."""
        sent = anchors.withColumns({"g": F.col("i") % parts, "s": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))}).repartition(tasks, "s", "g")
        return grid_rows.join(sent.hint("merge"), ["s", "g"]).drop("s", "g")

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _each(batches):
            a, r = m["a"], m["r"]
            score, ids = _tile(a, r), _longs(r["ids"])
            is_positive = _longs(a["labels"])[:, None] == _longs(r["labels"])
            block, place = _longs(a["own"]).reshape(2, -1)
            own = np.flatnonzero(block == r["j"])
            is_positive[own, place[own]] = False  # the anchor itself
            found = []
            for p in range(a["n"]):
                at = np.flatnonzero(is_positive[p])
                at = at[_first(score[p, at], ids[at], positives)]
                found.append((np.full(len(at), p), ids[at], score[p, at]))
            p, best, top = (np.concatenate(x) for x in zip(*found))
            columns = [np.full(len(p), m["i"], np.int32), p.astype(np.int32), _longs(a["ids"])[p], best, top]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["i", "p", "anchor_id", "positive_id", "positive_score"])

    anchors = asked.select("i", F.struct("n", "ids", "labels", "own", "x").alias("a"))
    best = Window.partitionBy("i", "p").orderBy(F.col("positive_score").desc(), "positive_id")
    windows = met(anchors).mapInArrow(best_positives, _BEST).withColumn("q", F.row_number().over(best)).where(F.col("q") <= positives)
    # One group's windows: positives times about ANCHORS.
    windows = windows.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("p", "q", "anchor_id", "positive_id", "positive_score"))).alias("w"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _each(batches):
            a, r = m["a"], m["r"]
            score, ids = _tile(a, r), _longs(r["ids"])
            other = _longs(a["labels"])[:, None] != _longs(r["labels"])
            out = []
            for w in m["w"]:
                s, top = score[w["p"]], w["positive_score"]
                at = np.flatnonzero((s >= -(-low * top // 100)) & (s <= high * top // 100) & other[w["p"]])
                at = at[_first(s[at], ids[at], negatives)]
                out += [(m["i"], w["p"], w["q"], w["anchor_id"], w["positive_id"], top, n, k) for n, k in zip(ids[at].tolist(), s[at].tolist())]
            yield _lines(out, _FOUND)

    found = met(anchors.join(checkpointed(windows), "i")).mapInArrow(search, _FOUND)
    order = Window.partitionBy("i", "p", "q").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    back = lambda c: F.nullif(F.col(c), F.lit(_NULL)).alias(c)
    return found.select("anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")


_FOUND = "i int, p int, q int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _anchor_blocks(packed: DataFrame, groups: int) -> DataFrame:
    """Blocks of anchors out of the blocks of rows, dealt by the hash of where they stand."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            at = np.flatnonzero(_longs(b["anchors"], np.uint8))
            n, x = len(at), _longs(b["x"], np.int32).reshape(b["n"], -1)[at]
            columns = [pa.array(np.full(n, b["j"])), pa.array(at), pa.array(_longs(b["ids"])[at]), pa.array(_longs(b["labels"])[at]), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["j", "at", "id", "label", "x"])

    found = packed.where("asked > 0").mapInArrow(members, "j long, at long, id long, label long, x binary")
    asked = found.withColumn("i", F.pmod(F.xxhash64("j", "at"), F.lit(groups)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by([("j", "ascending"), ("at", "ascending")])
        rows = [np.frombuffer(v, np.int32) for v in t["x"].to_pylist()]
        x = np.zeros((len(rows), max(map(len, rows))), np.int32)
        for k, v in enumerate(rows):
            x[k, : len(v)] = v
        own = np.concatenate([t[k].to_numpy() for k in ("j", "at")])
        return pa.Table.from_batches([_lines([(t["i"][0].as_py(), len(rows), t["id"].to_numpy().tobytes(), t["label"].to_numpy().tobytes(), own.tobytes(), x.tobytes())], _ANCHORS)])

    return asked.groupBy("i").applyInArrow(pack, _ANCHORS)
