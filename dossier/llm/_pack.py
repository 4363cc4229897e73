"""Carrying a table's own columns past an operator's, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(docs: DataFrame, **named: str) -> DataFrame:
    """Columns `named` (new name = old name), and all others of docs as one struct _row."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in named.values()]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()], row.alias("_row"))


def unpack(packed: DataFrame, docs: DataFrame, replaced: dict[str, Column] | None = None, extra: dict[str, Column] | None = None, **named: str) -> DataFrame:
    """The columns of docs in their order, from a packed table, and `extra` ones after them."""
    back = {old: F.col(new) for new, old in named.items()} | (replaced or {})
    own = [back.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]
    return packed.select(*own, *[c.alias(name) for name, c in (extra or {}).items()])


def whole_number(docs: DataFrame, key: str) -> None:
    """Ids are compared as longs; anything else is refused at once."""
    kind = dict(docs.dtypes)[key]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"column {key} holds {kind}; ids must be whole numbers")
