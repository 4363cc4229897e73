"""Search results and links: confidence, deduplication, rank, bounded crawl over a link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import html as H
from dossier.functions import text as X
from dossier.functions import urls as U


def confidence(url: Column, provider: Column) -> Column:
    """By the result's host if it is a known one (subdomains are not), else the provider's, else the default."""
    return F.coalesce(X.lookup(U.host(url), R.DOMAIN_CONFIDENCE), X.lookup(provider, R.PROVIDER_CONFIDENCE), F.lit(R.DEFAULT_CONFIDENCE))


def dedup_rank(results: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """One result for each URL key of a group: the surest, of equals the first seen; `position` from 1 in
    order of confidence, source, rank, and where the key was first seen."""
    keyed = results.withColumn("url_key", U.result_key(F.col("url")))
    by_key = Window.partitionBy(*group, "url_key")
    best = keyed.withColumns({"_nth": F.row_number().over(by_key.orderBy(F.col("confidence").desc(), seq)), "_first": F.min(seq).over(by_key)}).where("_nth = 1")
    order = Window.partitionBy(*group).orderBy(F.col("confidence").desc(), "source", "rank", "_first")
    return best.withColumn("position", F.row_number().over(order)).drop("_nth", "_first")


def link_score(path: Column, text: Column, keywords: tuple[str, ...]) -> Column:
    hay = F.lower(F.concat(path, F.lit(" "), text))
    return reduce(lambda a, b: a + b, [hay.contains(k).cast("int") for k in keywords])


def link_excluded(path: Column, text: Column) -> Column:
    hay = F.lower(F.concat(path, F.lit(" "), text))
    named = reduce(lambda a, b: a | b, [hay.contains(k) for k in R.EXCLUDED_LINKS])
    return named | (hay.contains(R.CAREERS_MARK) & hay.rlike(R.PAGED))


def page_links(pages: DataFrame) -> DataFrame:
    """All own-host links of pages (page_id, url, html): page_id, position, link, text, path."""
    out = pages.select("page_id", "url", F.posexplode(H.page_links(F.col("html"), F.col("url"))).alias("position", "x"))
    return out.select("page_id", "position", F.col("x.url").alias("link"), F.col("x.text").alias("text"), U.part(F.col("x.url"), 3).alias("path"))


def priority_links(links: DataFrame, keywords: tuple[str, ...] = R.CRAWL_LINKS) -> DataFrame:
    """page_id, link (crawl key), score: the best score of each link worth following, best first by `nth`."""
    kept = links.where(~link_excluded(F.col("path"), F.col("text"))).withColumn("score", link_score(F.col("path"), F.col("text"), keywords)).where("score > 0")
    best = kept.groupBy("page_id", U.crawl_key(F.col("link")).alias("link")).agg(F.max("score").alias("score"))
    return best.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc(), "link")))


def leadership_links(links: DataFrame, limit: int) -> DataFrame:
    """page_id, link (without fragment), score: the first `limit` pages that may list leaders."""
    kept = links.withColumn("score", link_score(F.col("path"), F.col("text"), R.LEADERSHIP_LINKS)).where("score > 0")
    best = kept.groupBy("page_id", F.regexp_replace("link", "#.*$", "").alias("link")).agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc(), "link"))
    return best.withColumn("nth", nth).where(F.col("nth") <= limit)


def crawl(seeds: DataFrame, links: DataFrame, pages: int = 8, depth: int = 2, fetched: DataFrame | None = None) -> DataFrame:
    """Bounded breadth-first crawl over a table of links: site, url, level, position (visits in order).

    seeds: site, url.  links: url (of a fetched page), link, score.  A URL that is not in links' pages was
    not fetched and costs nothing; fetched: the pages that were (url), where some have no links.  Each round is one
    join and a window; rounds are as many as the depth.  Of a level only its best `pages` go on: more cannot be visited."""
    fetched = links.select("url").distinct() if fetched is None else fetched.select("url").distinct()
    found = seeds.join(fetched, "url", "left_semi").select("site", "url", F.lit(0).alias("level"), F.lit(0).alias("score"))
    frontier = found
    for level in range(1, depth + 1):
        reached = frontier.select("site", "url").join(links, "url").groupBy("site", F.col("link").alias("url")).agg(F.max("score").alias("score"))
        fresh = reached.join(found.select("site", "url"), ["site", "url"], "left_anti").join(fetched, "url", "left_semi").withColumn("level", F.lit(level)).select("site", "url", "level", "score")
        fresh = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy("site").orderBy(F.col("score").desc(), "url"))).where(F.col("_nth") <= pages).drop("_nth")
        found = found.unionByName(fresh)
        frontier = fresh
    order = Window.partitionBy("site").orderBy("level", F.col("score").desc(), "url")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= pages).select("site", "url", "level", "position")


def page_summary(pages: DataFrame) -> DataFrame:
    """page_id, title, snippet: the description, else the first 240 characters of the text."""
    c = pages.select("page_id", H.page_content(F.col("html")).alias("c"))
    return c.select("page_id", "c.title", F.coalesce(F.when(F.col("c.description") != "", F.col("c.description")), F.substring("c.text", 1, 240)).alias("snippet"))


def selected_results(pages: DataFrame, container: str, title: str, url: str, snippet: str = "", most: int = 10) -> DataFrame:
    """page_id, rank, title, url (absolute), snippet of rendered results pages (page_id, url, html): what the selectors
    (tag, .class, #id) find in each container, at most `most` a page."""
    rows = H.result_rows(container, title, url, snippet, most)
    return pages.select("page_id", F.explode(rows(F.col("html"), F.col("url"))).alias("r")).select("page_id", "r.*")


def page_kind(url: Column, html: Column) -> Column:
    """Interstitial pages: consent, captcha, unusual_traffic; else content."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.when(url.contains("consent."), "consent").when(low.contains("captcha"), "captcha").when(low.contains("unusual traffic"), "unusual_traffic").otherwise("content")
