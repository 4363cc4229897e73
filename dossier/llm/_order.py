"""Order-preserving buckets: a total order over any number of rows without one sorting task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most buckets, whatever the input: their bounds are the only thing the driver sees.
MOST_BUCKETS = 4096


def buckets_for(df: DataFrame, per_partition: int = 4) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MOST_BUCKETS, per_partition * n))


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points (approximate quantiles) of a long column."""
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts that are <= key (null: 0), found in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    coarse = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    k = F.size(F.filter(coarse, lambda x: x <= key))
    inner = F.size(F.filter(F.element_at(fine, F.greatest(k, F.lit(1))), lambda x: x <= key))
    return F.when(key.isNull() | (k == 0), F.lit(0)).otherwise((k - 1) * step + inner).cast("int")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
