"""Contiguous shards of near-equal bytes.

Rows are ordered by id (null first; ties by text checksum, then size).  They fall into
order-preserving buckets; each bucket's byte and row totals (one line a bucket, a bounded number of
buckets) give the global prefix sums by adding the totals of earlier buckets to the running sums
inside one.  The prefix sum is cut at equal targets: a row belongs to the shard in whose share the
middle of its bytes lies, so no shard is off its target by more than one row's size.  Only ids, sizes
and checksums are shuffled, never the texts.

Defined cases: a null text counts as no bytes; an empty table gives no rows; repeated rows each get a
slot of their own; fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm._cut import checkpointed
from dossier.llm._order import bounds, bucket_of, buckets_for


def contiguous_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", size: Column | None = None) -> DataFrame:
    """Per row: `key`, size, text_crc32, shard (0 .. shards - 1), slot (0, 1, .. within a shard)."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16 if size is None else size
    rows = docs.select(F.col(key).alias("_key"), size.cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("text_crc32"))
    order = F.xxhash64("_key") if dict(rows.dtypes)["_key"] not in ("bigint", "int", "smallint", "tinyint") else F.col("_key").cast("long")
    rows = rows.withColumn("_order", order)
    cuts = bounds(docs.select(F.col(key).alias("_key")).select(order.alias("_order")), "_order", buckets_for(docs))
    run = Window.partitionBy("_bucket").orderBy("_order", "_key", "text_crc32", "size")
    rows = rows.withColumn("_bucket", bucket_of(F.col("_order"), cuts)).withColumn("_end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(run).cast("long"))
    rows = checkpointed(rows)  # a few bytes a row, read three times below
    # One line a bucket (MOST_BUCKETS at most).
    totals = {r["_bucket"]: (r["b"] or 0, r["n"]) for r in rows.groupBy("_bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    before, total, count = {}, 0, 0
    for b in sorted(totals):
        before[b] = (total, count)
        total, count = total + totals[b][0], count + totals[b][1]
    bytes_before = F.element_at(F.array(*[F.lit(before.get(b, (0, 0))[0]).cast("long") for b in range(len(cuts) + 1)]), F.col("_bucket") + 1)
    rows_before = F.element_at(F.array(*[F.lit(before.get(b, (0, 0))[1]).cast("long") for b in range(len(cuts) + 1)]), F.col("_bucket") + 1)
    # Exact integers: the middle of the row's bytes, counted twice, against twice the total.
    rows = rows.withColumn("_middle", 2 * (F.col("_end") + bytes_before) - F.col("size")).withColumn("_row", F.col("_nth") + rows_before - 1)
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"int((cast(_middle as decimal(30,0)) * {shards}) div {max(1, 2 * total)})")))
    firsts = {r["shard"]: r["f"] for r in rows.groupBy("shard").agg(F.min("_row").alias("f")).collect()}  # one line a shard
    first = F.element_at(F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_row") - first).alias("slot"))
