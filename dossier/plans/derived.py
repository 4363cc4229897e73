"""Contact tables derived from the supplied ones, in SQL that Spark and the oracle both run.

The supplied tables hold no contacts, so names, titles, addresses and evidence are made from keys by
arithmetic, with deliberate dirt.  `{customer}` and the like stand for tables: Spark fills in data
frames, the oracle the views' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTACTS = """
SELECT c_custkey AS k, c_mktsegment AS segment,
 CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  mary   ann ' WHEN 2 THEN 'JEAN-luc' WHEN 3 THEN 'robert' WHEN 4 THEN 'o' || chr(39) || 'neil'
  WHEN 5 THEN 'Anna' WHEN 6 THEN 'mcdonald' WHEN 7 THEN chr(9) || 'LEE' ELSE 'Sam' END AS first_name,
 CASE c_custkey % 11 WHEN 0 THEN 'van der BERG' WHEN 1 THEN 'macy' WHEN 2 THEN 'SMITH Jr.' WHEN 3 THEN 'garcia-lopez' WHEN 4 THEN 'lee' WHEN 5 THEN ' '
  WHEN 6 THEN 'O' || chr(39) || 'BRIEN III' WHEN 7 THEN 'de la cruz' WHEN 8 THEN 'x' || CAST(c_custkey AS string) || '!' WHEN 9 THEN 'Young Ph.D.'
  ELSE 'Person ' || CAST(c_custkey % 300 AS string) END AS last_name,
 CASE c_custkey % 14 WHEN 0 THEN NULL WHEN 1 THEN 'vp, sales' WHEN 2 THEN 'ceo' WHEN 3 THEN 'Senior Director of it' WHEN 4 THEN 'managing director'
  WHEN 5 THEN 'contractor' WHEN 6 THEN 'sr. manager r&d' WHEN 7 THEN 'Chief Experience Officer' WHEN 8 THEN 'hr  coordinator' WHEN 9 THEN 'Associate'
  WHEN 10 THEN 'jr analyst/ux' WHEN 11 THEN 'President' WHEN 12 THEN 'Executive Vice President - b2b' ELSE repeat('long title ', 10) || 'end' END AS title,
 CASE c_custkey % 6 WHEN 0 THEN 'C-Level' WHEN 1 THEN 'Vice Presidents' WHEN 2 THEN 'Board of Directors' WHEN 3 THEN 'Senior Vice Presidents' WHEN 4 THEN 'Managers' ELSE NULL END AS contact_level,
 CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN ' Info@Acme' || CAST(c_custkey % 50 AS string) || '.COM ' WHEN 2 THEN 'a b@X.com' WHEN 3 THEN 'bad.address' WHEN 4 THEN 'two@@x.com'
  WHEN 5 THEN 'User' || CAST(c_custkey AS string) || '@GMAIL.com' WHEN 6 THEN 'nodot@host' ELSE 'p' || CAST(c_custkey AS string) || '@acme' || CAST(c_custkey % 40 AS string) || '.com' END AS email,
 CASE WHEN c_custkey % 4 = 0 THEN 'Office@Acme' || CAST(c_custkey % 50 AS string) || '.com' END AS company_email,
 CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN chr(39) || '555-0101' WHEN 2 THEN '(555) 010-2000' WHEN 3 THEN '+44 20 7946 0958' WHEN 4 THEN '123' WHEN 5 THEN '1 555 010 3000' WHEN 6 THEN 'call me' ELSE '' END AS direct_phone,
 CASE WHEN c_custkey % 3 = 0 THEN '555 010 ' || lpad(CAST(c_custkey % 10000 AS string), 4, '0') END AS phone,
 CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 'Acme ' || CAST(c_custkey % 50 AS string) || ' inc' WHEN 2 THEN 'Acme  ' || CAST(c_custkey % 50 AS string) || ' Inc.' WHEN 3 THEN 'beta L.L.C.' WHEN 4 THEN 'Gamma, Limited'
  WHEN 5 THEN 'eBAY' WHEN 6 THEN 'delta corporation,' WHEN 7 THEN 'PWC, plc' WHEN 8 THEN 'Anna lee' WHEN 9 THEN 'omega' WHEN 10 THEN 'Lee COMPANY' ELSE 'Acme ' || CAST(c_custkey % 50 AS string) END AS company_name,
 CASE WHEN c_custkey % 5 = 0 THEN 'OMEGA' WHEN c_custkey % 5 = 1 THEN 'Parent Co' END AS parent_company,
 CASE c_custkey % 5 WHEN 0 THEN 'ACM' WHEN 1 THEN ' ' ELSE NULL END AS ticker,
 CASE c_custkey % 7 WHEN 0 THEN 'Private, Public' WHEN 1 THEN 'Private' ELSE NULL END AS ownership_type,
 CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE NULL END AS is_headquarters,
 CASE c_custkey % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'a description of some length' ELSE NULL END AS business_description,
 CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS string), 9, '0') WHEN 1 THEN ' ' || lpad(CAST(c_custkey AS string), 9, '0') WHEN 2 THEN '12-345' ELSE NULL END AS duns_number,
 CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '12 Main Street' WHEN 2 THEN '5 old mill  ROAD, rear' WHEN 3 THEN ' ' WHEN 4 THEN 'Springfield' WHEN 5 THEN 'omega' ELSE 'One Park Avenue' END AS address_line_1,
 CASE c_custkey % 5 WHEN 0 THEN 'springfield' WHEN 1 THEN NULL ELSE 'Dover' END AS city,
 CASE c_custkey % 6 WHEN 0 THEN 'new york' WHEN 1 THEN 'CA' WHEN 2 THEN 'District of Columbia' WHEN 3 THEN 'Bavaria' WHEN 4 THEN '' ELSE NULL END AS state_or_province,
 CASE c_custkey % 5 WHEN 0 THEN '12345' WHEN 1 THEN '12345-6789' WHEN 2 THEN '1234' WHEN 3 THEN NULL ELSE 'SW1A 1AA' END AS postal_code,
 CASE c_custkey % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'us' WHEN 2 THEN 'Germany' WHEN 3 THEN ' canada ' WHEN 4 THEN 'Atlantis' ELSE NULL END AS country,
 CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS sales_usd,
 CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 2 END AS assets_usd,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 90 AS double) END AS employees_single_site,
 CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 70 AS double) - 3 END AS employees_total,
 CASE c_custkey % 6 WHEN 0 THEN 'Pet Food' WHEN 1 THEN '' ELSE NULL END AS industry_label,
 CASE c_custkey % 5 WHEN 0 THEN ' 311111' WHEN 1 THEN '999999' WHEN 2 THEN '561110' ELSE NULL END AS naics_code,
 CASE c_custkey % 4 WHEN 0 THEN 'Dog food' WHEN 1 THEN ' ' ELSE NULL END AS naics_description,
 CASE c_custkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' ELSE NULL END AS tps_flag,
 CASE c_custkey % 7 WHEN 0 THEN 'https://www.acme' || CAST(c_custkey % 50 AS string) || '.com/about' WHEN 1 THEN 'acme' || CAST(c_custkey % 40 AS string) || '.com' WHEN 2 THEN 'not a url' WHEN 3 THEN 'ftp://files.acme.com' WHEN 4 THEN ' ' WHEN 5 THEN NULL
  ELSE 'www.acme' || CAST(c_custkey % 40 AS string) || '.com/x' END AS url,
 CASE WHEN c_custkey % 2 = 0 THEN 'list ' || n_name END AS source,
 CASE WHEN c_custkey % 9 = 0 THEN 'dd' || CAST(c_custkey % 5 AS string) END AS dedup_id
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
TITLES = ("Manager", "Director", "Vice President", "CEO", "Analyst", "Senior Manager", "President", "contractor", "Painter", "Head of Sales")
_TITLE = "CASE {x} % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TITLES)) + " END"
PEOPLE = f"""
SELECT c_custkey AS k, 'row:' || CAST(c_custkey AS string) AS subject_id, c_mktsegment AS segment,
 CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'First' || CAST(c_custkey % 97 AS string) END AS first_name,
 CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'Last' || CAST(c_custkey % 113 AS string) END AS last_name,
 CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {_TITLE.format(x="c_custkey")} END AS title,
 CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'Company ' || CAST(c_custkey % 60 AS string) END AS company_name,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'P' || CAST(c_custkey AS string) || '@c' || CAST(c_custkey % 60 AS string) || '.com' END AS email,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '+1 555 ' || CAST(c_custkey % 200 AS string) END AS phone,
 CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS string), 9, '0') END AS duns_number,
 'City ' || CAST(c_custkey % 12 AS string) AS city,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://c' || CAST(c_custkey % 60 AS string) || '.com' END AS url
FROM {{customer}}
"""
STORED = """
SELECT 'id:' || CAST(k AS string) AS subject_id, first_name || ' ' || last_name AS name, title, company_name AS company,
 CASE WHEN k % 5 = 0 THEN 'old' || CAST(k AS string) || '@c.com' ELSE email END AS email,
 CASE WHEN k % 4 = 0 THEN '+1 666 ' || CAST(k % 90 AS string) ELSE phone END AS phone, duns_number, url
FROM people WHERE k % 3 <> 1
"""
OBSERVED = f"""
SELECT subject_id, 'full_name' AS attribute, first_name || '  ' || last_name AS value, 'google_search' AS provider_id FROM people WHERE k % 4 <> 0 AND first_name IS NOT NULL
UNION ALL SELECT subject_id, 'full_name', 'New Person', 'company_website' FROM people WHERE k % 29 = 0
UNION ALL SELECT subject_id, 'title', {_TITLE.format(x="(k * 7 + 3)")}, 'google_search' FROM people WHERE k % 4 <> 0 AND k % 3 <> 0
UNION ALL SELECT subject_id, 'title', ' ' || lower({_TITLE.format(x="k")}), 'company_website' FROM people WHERE k % 9 = 0
UNION ALL SELECT subject_id, 'title', 'Board Member', 'company_website' FROM people WHERE k % 31 = 0
UNION ALL SELECT subject_id, 'company_name', 'Company ' || CAST((k + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 60 AS string), 'company_website' FROM people WHERE k % 2 = 0 AND k % 4 <> 0 OR k % 8 = 0
UNION ALL SELECT subject_id, 'email', CASE WHEN k % 6 = 0 THEN 'new' || CAST(k AS string) || '@c.com' ELSE upper(coalesce(email, 'x@y.com')) END, 'google_search' FROM people WHERE k % 3 = 0
UNION ALL SELECT subject_id, 'phone', CASE WHEN k % 10 = 0 THEN '555 1' ELSE '+1-555-' || CAST(k % 200 AS string) END, 'google_search' FROM people WHERE k % 5 = 0
UNION ALL SELECT subject_id, 'title', ' ', 'google_search' FROM people WHERE k % 13 = 0
"""
RESULTS = """
SELECT page_id % 50 AS subject_id, page_id * 5 + s AS seq, CASE WHEN s = 1 THEN url || '/' WHEN s = 2 THEN url || '#top' WHEN s = 3 THEN upper(substr(url, 1, 4)) || substr(url, 5) WHEN s = 4 THEN 'https://www.reuters.com/a' || CAST(page_id % 7 AS string) ELSE url END AS url,
 'title ' || CAST(page_id AS string) AS title,
 CASE s WHEN 0 THEN 'company_crawler' WHEN 1 THEN 'press_release' WHEN 2 THEN 'google_web_search' WHEN 3 THEN 'news_search' ELSE 'other' END AS source, CAST(page_id % 9 + 1 AS int) AS rank
FROM {pages} CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x
"""
ANNOUNCEMENTS = """
SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'Jane Doe, Chief Financial Officer of Beta Inc.' ELSE 'News of the day' END AS title,
 CASE c_custkey % 8 WHEN 0 THEN 'Today Mary Ann Smith was appointed as the Chief Executive Officer of Acme Corp. She retires soon.'
  WHEN 1 THEN 'John Q. Public has been promoted to the role of Vice President at Gamma Ltd, effective now.'
  WHEN 2 THEN 'Ana Lopez joins Delta Group as its Director. Mail ana.lopez@delta-group.com or +1 (555) 010-2000 now.'
  WHEN 3 THEN 'we met Peter Parker, Senior Editor at Daily Bugle; the board agreed'
  WHEN 4 THEN 'Bruce Wayne is promoted to Chairman. See https://www.linkedin.com/in/bruce-wayne/ for more'
  WHEN 5 THEN 'The firm acquires a rival and its successor steps down' WHEN 6 THEN 'nothing to see in ' || c_mktsegment
  ELSE 'Clark Kent named Reporter of Planet ' || CAST(c_custkey % 5 AS string) || '! He resigned before.' END AS body
FROM {customer}
"""
ATTEMPTS = "SELECT user_id AS provider_id, event_id AS seq, event_type <> 'error' AS ok, ts FROM {events}"


def frame(spark: SparkSession, sf_dir: str, sql: str, *views: str) -> DataFrame:
    """The rows of one of the queries above; views: queries that it names (people)."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "pages", "events") if "{" + t + "}" in sql or any("{" + t + "}" in v for v in views)}
    if "people" in sql and views:
        sql = sql.replace("FROM people", "FROM {people}")
        tables["people"] = spark.sql(PEOPLE, customer=tables.pop("customer"))
    return spark.sql(sql, **tables)


def plain(sql: str) -> str:
    """The same for the oracle."""
    for t in ("customer", "nation", "pages", "events"):
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()
