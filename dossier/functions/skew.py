"""Joins whose left side has keys that hold a large part of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more left rows is spread over several tasks, so many rows in each.
HOT = 100_000
#: Only the most frequent keys are spread; each of the others holds less than this fraction of all rows.
MOST = 1000


def hot_keys(left: DataFrame, keys: list[str], hot: int = HOT, most: int = MOST) -> DataFrame:
    """The keys of more than `hot` rows, with `_salts`: at most `most` rows, the most frequent keys."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    top = counts.orderBy(F.col("_n").desc(), *keys).limit(most)
    return top.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", hot: int = HOT, most: int = MOST) -> DataFrame:
    """left join right on keys, where a hot key's left rows are dealt by a hash of their `spread` columns.

    Each of its right rows is copied once a part, so the right side should hold few rows of one key.  how: inner or left.  The
    list of hot keys is broadcast: `most` rows at most, whatever the tables hold.  Rows of the result are those of the plain
    join, columns too; a null key joins with nothing."""
    if how not in ("inner", "left"):
        raise ValueError(f"a salted join is inner or left, not {how}")
    few = F.broadcast(hot_keys(left, keys, hot, most))
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(few, keys, "left").withColumn("_salt", F.when(salts > 1, F.pmod(F.xxhash64(*spread), salts)).otherwise(0).cast("int")).drop("_salts")
    b = right.join(few, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
