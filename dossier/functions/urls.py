"""URL functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where absent (parse_url gives up on odd URLs)."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    """Authority in lower case without a leading www.; other subdomains stay."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def result_key(url: Column) -> Column:
    """scheme://authority/path?query: fragment dropped, one trailing slash dropped but at the root."""
    path = part(url, 3)
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    query = part(url, 4)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def crawl_key(url: Column) -> Column:
    """Without fragment and one trailing slash, the root's included."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    by_path = F.lower(part(url, 3)).endswith(".pdf")
    return by_path if content_type is None else by_path | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def unquoted(c: Column) -> Column:
    """Percent-encoding taken back; a stray % and a + stay as they are.  Two paths are the same if their unquoted forms are."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), c)
