"""Text functions of the rules, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip(c: Column) -> Column:
    """White space off both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Control characters out, runs of blanks and tabs to one blank, ends stripped; inner line ends stay."""
    return strip(F.regexp_replace(F.regexp_replace(c, _CONTROL, ""), r"[ \t]+", " "))


def collapse(c: Column) -> Column:
    """All white space to single blanks, ends stripped, lower case: the key under which texts are compared."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def present(c: Column, kind: str = "string") -> Column:
    return (c.isNotNull() & (strip(c) != "")) if kind == "string" else c.isNotNull()


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """The table's value at c, or the default: a literal map, for tables of some dozens of entries."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def tokens(c: Column, separator: str = r"\s+") -> Column:
    """Separators and the words between them, in order; joined they give the text again."""
    return F.regexp_extract_all(c, F.lit(rf"({separator}|(?:(?!{separator}).)+)"), 1) if separator != r"\s+" else F.regexp_extract_all(c, F.lit(r"(\s+|\S+)"), 1)


def map_tokens(c: Column, change, separator: str = r"\s+") -> Column:
    return F.array_join(F.transform(tokens(c, separator), change), "")


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def domain_of_email(c: Column) -> Column:
    d = F.lower(F.substring_index(c, "@", -1))
    return F.when(c.contains("@") & (d != ""), d)


def domain_of_url(c: Column) -> Column:
    bare = F.lower(F.substring_index(F.regexp_replace(strip(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "/", 1))
    bare = F.regexp_replace(bare, r"^www\.", "")
    return F.when((strip(c) != "") & (bare != ""), bare)


def nfc(c: Column) -> Column:
    """Canonical composition of texts that are not ASCII, by the Unicode library on Spark's class path."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def number(c: Column) -> Column:
    """A double as Python writes it: plain from 0.0001 up to 1e16, beyond with a signed exponent of two digits."""
    s = c.cast("string")
    exponent = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(.*)E", 1), r"\.0$", "")
    sign = F.when(exponent < 0, "-").otherwise("+")
    far = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.when(exponent.isNull(), s).when(exponent.between(-4, 15), plain).otherwise(far)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts.  Not symmetric: the first is the stored value."""
    from difflib import SequenceMatcher

    known: dict[tuple[str, str], float] = {}

    def ratio(x, y):
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        if (x, y) not in known:
            if len(known) > 100_000:
                known.clear()
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


#: From this length of the second text on, difflib leaves popular characters out, and no bound below holds.
_JUNK = 200


def ratio_known(a: Column, b: Column) -> Column:
    """difflib's ratio where it can be said without searching: equal texts, one inside the other, no common character;
    else null."""
    total = F.length(a) + F.length(b)
    inside = (a.contains(b) | b.contains(a)) & (F.length(b) < _JUNK)
    apart = F.length(F.call_function("translate", a, b, F.lit(""))) == F.length(a)
    return F.when(a == b, 1.0).when(apart, 0.0).when(inside, 2 * F.least(F.length(a), F.length(b)) / total)


def ratio_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """A least and a greatest value of difflib's ratio, as columns.

    It matches no more characters than the two texts have in common, each as often as in the one that has fewer of
    it, and at least as many as their common beginning or end: its first match is the longest there is."""
    total = F.length(a) + F.length(b)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda x: x != "")), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    places = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: n > 0)
    begin = F.size(F.filter(places, lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))
    end = F.size(F.filter(places, lambda n: F.substr(a, F.length(a) - n + 1) == F.substr(b, F.length(b) - n + 1)))
    low = F.when(F.length(b) < _JUNK, 2 * F.greatest(begin, end) / total).otherwise(0.0)
    return F.when(total > 0, low).otherwise(1.0), F.when(total > 0, 2 * shared / total).otherwise(1.0)
