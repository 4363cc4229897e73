"""Guarded evaluation: what fails for a row becomes a value of that row, and no other row notices.

Three forms, all of which say in the end whether a row failed:

* `packed` evaluates any expression of Spark (one that calls raise_error, an ANSI cast, an index out of
  bounds) inside a try_ function, which gives null for a row whose argument raised; a marker before the
  value tells that from a value that is null.  It stays in generated code.
* `python` calls a Python function row by row in Arrow batches and catches what it raises.
* a rule may give a result itself: `ok` and `fail`, a struct of value and error.

`packed` carries values as text, so it takes text, numbers, booleans, dates and timestamps; text that is
not valid UTF-8 comes back with replacement characters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CARRIED = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def packed(c: Column) -> Column:
    """The value of c as binary; null exactly for the rows where evaluating c raises."""
    marked = F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    return F.try_to_binary(marked, F.lit("utf-8"))


def carried(kind: str) -> bool:
    """Whether `packed` can carry values of this type."""
    return kind in _CARRIED or kind.startswith("decimal")


def raised(p: Column) -> Column:
    return p.isNull()


def unpacked(p: Column, kind: str) -> Column:
    """The value of a packed column; null where it raised."""
    text = p.cast("string")
    value = F.when(text.startswith("+"), F.substr(text, F.lit(2)))
    return value if kind == "string" else value.try_cast(kind)


def ok(c: Column) -> Column:
    return F.struct(c.alias("value"), F.lit(None).cast("string").alias("error"))


def fail(message: Column | str) -> Column:
    """A result that has failed; goes into when() beside `ok`."""
    return F.struct(F.lit(None).alias("value"), (F.lit(message) if isinstance(message, str) else message).alias("error"))


def is_result(kind: str) -> bool:
    return kind.startswith("struct<value:") and kind.endswith(",error:string>")


def result_kind(kind: str) -> str:
    return kind.removeprefix("struct<value:").removesuffix(",error:string>")


def python(function: Callable, kind: str) -> Callable[..., Column]:
    """A Python function of some columns' values (null: None) as a result: its value, or what it raised."""

    def one(row: tuple) -> tuple:
        try:
            return function(*[None if v is None or v is pd.NA or v != v else v for v in row]), None
        except Exception as error:  # noqa: BLE001 - any error of this row is this row's result
            return None, str(error) or type(error).__name__

    @F.pandas_udf(f"value {kind}, error string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [one(r) for r in rows.itertuples(index=False, name=None)]
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return lambda *columns: run(F.struct(*columns))
