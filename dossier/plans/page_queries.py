"""Named queries over pages, search results, announcements and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions.cut import shared_folder
from dossier.functions import text as X
from dossier.functions import urls as U
from dossier.operators import extraction, search
from dossier.plans import derived
from dossier.sources import landed

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


# ---- URLs and results -----------------------------------------------------------------------------------------

_authority = lambda u: f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_path = lambda u: f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_query = lambda u: f"regexp_extract({u}, '\\?([^#]*)', 1)"
_host = lambda u: f"regexp_replace(lower({_authority(u)}), '^www\\.', '')"
_key = lambda u: f"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || lower({_authority(u)}) || CASE WHEN {_path(u)} <> '/' THEN regexp_replace({_path(u)}, '/$', '') ELSE '/' END || CASE WHEN {_query(u)} <> '' THEN '?' || {_query(u)} ELSE '' END"
_conf = lambda u, p: f"coalesce(CASE {_host(u)} " + " ".join(f"WHEN '{h}' THEN {c}" for h, c in R.DOMAIN_CONFIDENCE.items()) + f" END, CASE {p} " + " ".join(f"WHEN '{h}' THEN {c}" for h, c in R.PROVIDER_CONFIDENCE.items()) + f" END, {R.DEFAULT_CONFIDENCE})"
_results = f"WITH results AS MATERIALIZED ({derived.plain(derived.RESULTS)})"


def results(spark, d):
    r = derived.frame(spark, d, derived.RESULTS)
    return r.withColumn("confidence", search.confidence(F.col("url"), F.col("source")))


@query("url_key", f"SELECT page_id, {_key('url')} AS url_key, {_host('url')} AS host FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", U.result_key(F.col("url")).alias("url_key"), U.host(F.col("url")).alias("host"))


@query("search_confidence", _results + f" SELECT seq, CAST({_conf('url', 'source')} AS double) AS confidence FROM results")
def _(spark, d):
    return results(spark, d).select("seq", "confidence")


@query("search_dedup_rank", _results + f", keyed AS (SELECT *, {_key('url')} AS url_key, CAST({_conf('url', 'source')} AS double) AS confidence FROM results), best AS (SELECT *, min(seq) OVER (PARTITION BY subject_id, url_key) AS f FROM keyed QUALIFY row_number() OVER (PARTITION BY subject_id, url_key ORDER BY confidence DESC, seq) = 1) SELECT subject_id, url_key, seq, source, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, source, rank, f) AS int) AS position FROM best")
def _(spark, d):
    return search.dedup_rank(results(spark, d), ["subject_id"]).select("subject_id", "url_key", "seq", "source", "position")


# ---- links of pages ---------------------------------------------------------------------------------------------

# The supplied pages' links hold no keyword, so scores are taken over links made from their ids; page_links reads the real ones.
_made = """SELECT page_id, 'https://h' || CAST(page_id % 20 AS string) || '.com' || p || CASE WHEN page_id % 3 = 0 THEN '#x' ELSE '' END AS link, p AS path, t AS text
 FROM {pages} CROSS JOIN (SELECT '/about/leadership/' AS p, 'Our Team' AS t UNION ALL SELECT '/about/leadership', 'Management board' UNION ALL SELECT '/careers/page/2', 'people' UNION ALL SELECT '/careers', 'people'
 UNION ALL SELECT '/login', 'team' UNION ALL SELECT '/press-room/releases', 'Media and news' UNION ALL SELECT '/investor-relations', 'Announcements' UNION ALL SELECT '/x', 'nothing' UNION ALL SELECT '/staff', 'who-we-are') y WHERE (page_id + length(p)) % 3 <> 0"""
_links = f"WITH links AS MATERIALIZED ({derived.plain(_made)})"


def made_links(spark, d):
    return derived.frame(spark, d, _made)


@query("page_links", f"""WITH anchors AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
 SELECT page_id, count(*) AS links FROM anchors WHERE NOT starts_with(href, '#') AND href <> '' AND ((regexp_matches(href, '^https?://') AND {_authority('href')} = {_authority('url')}) OR NOT regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')) AND NOT starts_with(href, '//') GROUP BY page_id""")
def _(spark, d):
    return search.page_links(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("links"))


_score = lambda words: " + ".join(f"CAST(contains(lower(path || ' ' || text), '{w}') AS int)" for w in words)
_excluded = " OR ".join(f"contains(lower(path || ' ' || text), '{w}')" for w in R.EXCLUDED_LINKS) + f" OR (contains(lower(path || ' ' || text), '{R.CAREERS_MARK}') AND regexp_matches(lower(path || ' ' || text), '{R.PAGED}'))"


@query("link_scores", _links + f" SELECT page_id, regexp_replace(regexp_replace(link, '#.*$', ''), '/$', '') AS link, max({_score(R.CRAWL_LINKS)}) AS score FROM links WHERE NOT ({_excluded}) AND {_score(R.CRAWL_LINKS)} > 0 GROUP BY ALL")
def _(spark, d):
    return search.priority_links(made_links(spark, d)).select("page_id", "link", "score")


@query("link_topk", _links + f", best AS (SELECT page_id, regexp_replace(link, '#.*$', '') AS link, max({_score(R.LEADERSHIP_LINKS)}) AS score FROM links WHERE {_score(R.LEADERSHIP_LINKS)} > 0 GROUP BY ALL) SELECT page_id, link, score FROM best QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) <= 2")
def _(spark, d):
    return search.leadership_links(made_links(spark, d), 2).select("page_id", "link", "score")


@query("press_links", _links + f" SELECT page_id, regexp_replace(regexp_replace(link, '#.*$', ''), '/$', '') AS link, max({_score(R.PRESS_LINKS)}) AS score FROM links WHERE NOT ({_excluded}) AND {_score(R.PRESS_LINKS)} > 0 GROUP BY ALL")
def _(spark, d):
    return search.priority_links(made_links(spark, d), R.PRESS_LINKS).select("page_id", "link", "score")


_graph = "SELECT 'u' || CAST(o_custkey % 40 AS string) AS url, 'u' || CAST(o_orderkey % 60 AS string) AS link, CAST(1 + o_orderkey % 5 AS int) AS score FROM {orders}"


@query("crawl_bfs", f"""WITH links AS MATERIALIZED ({_graph.replace('{orders}', 'orders')}), fetched AS (SELECT DISTINCT url FROM links),
 l0 AS (SELECT 's' || CAST(n AS string) AS site, 'u' || CAST(n AS string) AS url, 0 AS level, 0 AS score FROM (SELECT unnest([1, 7, 50]) AS n) WHERE 'u' || CAST(n AS string) IN (FROM fetched)),
 l1 AS (SELECT site, link AS url, 1 AS level, max(links.score) AS score FROM l0 JOIN links USING (url) WHERE link IN (FROM fetched) AND NOT EXISTS (SELECT 1 FROM l0 z WHERE z.site = l0.site AND z.url = link) GROUP BY ALL),
 l2 AS (SELECT site, link AS url, 2 AS level, max(links.score) AS score FROM l1 JOIN links USING (url) WHERE link IN (FROM fetched) AND NOT EXISTS (SELECT 1 FROM l0 z WHERE z.site = l1.site AND z.url = link) AND NOT EXISTS (SELECT 1 FROM l1 z WHERE z.site = l1.site AND z.url = link) GROUP BY ALL),
 every AS (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2) SELECT site, url, level, CAST(row_number() OVER (PARTITION BY site ORDER BY level, score DESC, url) AS int) AS position FROM every QUALIFY position <= 8""")
def _(spark, d):
    links = spark.sql(_graph, orders=spark.read.parquet(f"{d}/orders.parquet"))
    seeds = spark.createDataFrame([(f"s{n}", f"u{n}") for n in (1, 7, 50)], "site string, url string")
    return search.crawl(seeds, links)


# ---- page content and facts -----------------------------------------------------------------------------------------

@query("page_content", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def _(spark, d):
    from dossier.functions import html as H

    return pages(spark, d).select("page_id", H.page_content(F.col("html"))["title"].alias("title"))


@query("page_summary")
def _(spark, d):
    return search.page_summary(pages(spark, d))


@query("page_observations")
def _(spark, d):
    p = pages(spark, d)
    r = p.select(F.col("page_id").alias("subject_id"), "url", F.lit("a result").alias("title"), F.lit("").alias("snippet"), F.lit("company_crawler").alias("source"), F.lit(1).alias("rank"), F.lit(1.0).alias("confidence"))
    return extraction.observations(r, p.select("url", "html")).select("subject_id", "attribute", "value", "evidence_type")


@query("doc_contacts", "SELECT doc_id, nullif(regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', 0), '') IS NOT NULL AS has_email, nullif(regexp_extract(text, '\\+?\\d[\\d\\-.\\s()]{7,}\\d', 0), '') IS NOT NULL AS has_phone FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", extraction.email(F.col("text")).isNotNull().alias("has_email"), extraction.phone(F.col("text")).isNotNull().alias("has_phone"))


_news = f"WITH news AS MATERIALIZED ({derived.plain(derived.ANNOUNCEMENTS)})"
_word = lambda p: "regexp_matches(title || ' ' || body, '(?i)" + p + "')"


@query("doc_event_keywords", _news + " SELECT k, nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_word(p)} THEN '{label}' END" for label, p in R.EVENTS) + "], lambda x: x IS NOT NULL), ', '), '') AS event_keywords FROM news")
def _(spark, d):
    n = derived.frame(spark, d, derived.ANNOUNCEMENTS)
    return n.select("k", extraction.event_keywords(F.concat("title", F.lit(" "), "body")).alias("event_keywords"))


def _oracle_fact(letter):
    """The oracle's regular expressions have no look-ahead: the edge is consumed instead."""
    tries = []
    for column in ("title", "body"):
        for _, pattern, groups in R.FACTS:
            p = pattern.replace("(?=[.,;:!?\\n]|$)", "(?:[.,;:!?\\n]|$)").replace("'", "''")
            value = f"nullif(trim(trim(regexp_extract({column}, '{p}', {groups.index(letter) + 1})), ','), '')" if letter in groups else "NULL"
            tries.append(f"WHEN regexp_matches({column}, '{p}') THEN {value}")
    return "CASE " + " ".join(tries) + " END"


@query("doc_facts", _news + f" SELECT k, {_oracle_fact('n')} AS full_name, {_oracle_fact('r')} AS role, {_oracle_fact('c')} AS company_name, nullif(regexp_extract(body, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', 0), '') AS email, nullif(trim(regexp_extract(body, '\\+?\\d[\\d\\-.\\s()]{{7,}}\\d', 0)), '') AS phone, nullif(regexp_extract(body, '{R.PROFILE_SHAPE}', 0), '') AS profile_url FROM news")
def _(spark, d):
    n = extraction.facts(derived.frame(spark, d, derived.ANNOUNCEMENTS), "title", "body")
    return n.select("k", "fact.full_name", F.col("fact.title").alias("role"), "fact.company_name", "email", "phone", "profile_url")


_items = "SELECT page_id AS subject_id, 'q' AS query, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Title ' || CAST(page_id AS string) END AS title, url, page_id FROM {pages}"


@query("search_payload", f"WITH i AS ({derived.plain(_items)}) SELECT subject_id, title, url, {_authority('url')} AS domain, CASE WHEN page_id % 3 = 0 THEN '2024-05-0' || CAST(page_id % 9 AS string) END AS published_at FROM i WHERE title <> ''")
def _(spark, d):
    i = derived.frame(spark, d, _items)
    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2024-05-0"), (F.col("page_id") % 9).cast("string")))
    item = F.struct("title", F.col("url").alias("link"), F.struct(F.array(F.map_filter(F.create_map(F.lit("date"), date), lambda k, v: v.isNotNull())).alias("metatags")).alias("pagemap"))
    payload = F.to_json(F.struct(F.array(item).alias("items")))
    return landed.search_items(i.select("subject_id", "query", payload.alias("payload"))).select("subject_id", "title", "url", "domain", "published_at")


_robots = "SELECT DISTINCT h AS host FROM (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM {pages}) x"


@query("robots_gate", f"SELECT page_id, NOT (length({_authority('url')}) % 2 = 0 AND ((starts_with({_path('url')}, '/de') AND NOT starts_with({_path('url')}, '/de/1')) OR starts_with({_path('url')}, '/fr/1'))) AS allowed FROM pages")
def _(spark, d):
    p = pages(spark, d)
    hosts = p.select(F.lower(U.part(F.col("url"), 2)).alias("host")).distinct()
    # The first line for a path holds, so /de/2 stays forbidden; only the first group for all counts; `other` is nobody here.
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *   # everyone\nAllow: /de/1\nDisallow: /de\nAllow: /de/2\nDisallow: /fr/1\nAllow: /fr\n\nUser-agent: *\nDisallow: /\n")
    files = hosts.select("host", F.when(F.length("host") % 2 == 0, 200).otherwise(404).alias("http_status"), body.alias("body"))
    return landed.allowed(p, landed.robots_rules(files)).select("page_id", "allowed")


#: The same paths and rules in other encodings: whatever way either is written, the rule holds.
_encoded = "SELECT page_id, 'http://h' || CAST(page_id % 3 AS string) || '.com' || CASE page_id % 10 WHEN 0 THEN '/a%20b/' || CAST(page_id AS string) WHEN 1 THEN '/a b' WHEN 2 THEN '/%c3%A9t%C3%A9' WHEN 3 THEN '/été' WHEN 4 THEN '/q%3Fx=1' WHEN 5 THEN '/p+q' WHEN 6 THEN '/p%20q' WHEN 7 THEN '/100%/x' WHEN 8 THEN '/a%2520b' ELSE '/%61%20b' END AS url FROM {pages}"


@query("robots_encoded", "SELECT page_id, page_id % 10 IN (6, 8) OR page_id % 3 = 2 AS allowed FROM pages")
def _(spark, d):
    p = derived.frame(spark, d, _encoded)
    body = F.lit("User-agent: *\nDisallow: /a%20b\nDisallow: /ét\nDisallow: /q?x\nDisallow: /p%2Bq\nDisallow: /100%25\n")
    files = spark.createDataFrame([("h0.com",), ("h1.com",), ("h2.com",)], "host string").select("host", F.when(F.col("host") == "h2.com", 404).otherwise(200).alias("http_status"), body.alias("body"))
    return landed.allowed(p, landed.robots_rules(files)).select("page_id", "allowed")


@query("clean_nfc", "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(X.nfc(F.col("text")), 256).alias("nfc_sha256"))


# ---- streams --------------------------------------------------------------------------------------------------------

def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _own_folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_streaks = "WITH a AS (SELECT user_id AS provider_id, event_id AS seq, event_type <> 'error' AS ok FROM events), i AS (SELECT *, sum(CAST(ok AS int)) OVER (PARTITION BY provider_id ORDER BY seq) AS g FROM a)"


@query("stream_health", _streaks + " SELECT provider_id, seq, CAST(n AS int) AS consecutive_failures, CASE WHEN n >= 3 THEN 'unhealthy' WHEN n > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT provider_id, seq, sum(CAST(NOT ok AS int)) OVER (PARTITION BY provider_id, g ORDER BY seq) AS n FROM i)")
def _(spark, d):
    from dossier.streaming import health

    a = _stream(spark, d).select(F.col("user_id").alias("provider_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return health.run_breaker(a, _own_folder(spark))


@query("stream_window_activity", "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS events, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def _(spark, d):
    from dossier.streaming import health

    return health.run_to_files(health.activity(_stream(spark, d)), _own_folder(spark))
