"""Connected components of a graph that no task and no driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm._cut import checkpointed, release


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (u, v: longs).

    Large-star and small-star steps in turn: every step hangs the neighbours of a node on the least of
    them, so the depth of the trees falls until all are stars.  Lineage is cut after each round."""
    e = checkpointed(_oriented(edges))
    sign = _sign(e)
    while True:
        # Large star: neighbours above a node go to the least neighbour (or the node itself).
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _oriented(large)
        # Small star: neighbours below a node, and the node, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e, old = checkpointed(_oriented(small)), e
        release(old)
        now = _sign(e)
        if now == sign:
            break
        sign = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
