"""Named queries over runs from landed tables: who ran, what was seen, what broke; with their SQL.

The supplied tables hold no answers of providers, so payloads, sites and pages are made from the customers'
keys, with failures, unreadable answers and unparsable pages among them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.operators import evidence, providers, subjects
from dossier.operators.evidence import Landed
from dossier.plans import derived, record_queries
from dossier.plans.page_queries import _oracle_fact

QUERIES, SQL = {}, {}
_RUN = "TIMESTAMP '2024-06-01 00:00:00'"
#: provider, stages, priority, fallback only, enabled.
REGISTRY = [
    ("company_website", ("person", "company"), 1, False, True), ("google_search", ("person",), 2, False, True), ("press_release", ("search",), 1, False, True),
    ("google_web_search", ("search",), 2, False, True), ("news_search", ("search",), 3, True, True), ("linkedin_search", ("search",), 4, False, False),
]
#: google_search begins with two failures in a row.
BEGUN = {"google_search": 2}


def _page(k: str) -> str:
    return f"'https://news' || CAST(({k}) % 5 AS string) || '.com/a/' || CAST({k} AS string)"


def _item(title: str, k: str) -> str:
    return f"chr(123) || '\"title\":\"{title} ' || CAST(k AS string) || '\",\"link\":\"' || {_page(k)} || '\",\"snippet\":\"s\"' || chr(125)"


def _items(*items: str) -> str:
    return "chr(123) || '\"items\":[' || " + " || ',' || ".join(items or ("''",)) + " || ']' || chr(125)"


PAYLOADS = f"""
SELECT subject_id, k, 'press_release' AS provider_id, 'q' AS query, CASE WHEN k % 10 = 4 THEN 'no json' ELSE {_items(_item("Press", "k"))} END AS payload, CASE WHEN k BETWEEN 900 AND 905 THEN 'HTTP 503' END AS error FROM people WHERE k % 3 <> 1
UNION ALL SELECT subject_id, k, 'google_web_search', 'q', CASE WHEN k % 4 = 0 THEN {_items(_item("Web", "k"), _item("Web", "k + 1"))} ELSE {_items()} END, CAST(NULL AS string) FROM people WHERE k % 2 = 0
UNION ALL SELECT subject_id, k, 'news_search', 'q', {_items(_item("News", "k + 2"))}, CASE WHEN k BETWEEN 400 AND 470 THEN 'HTTP 500' END FROM people WHERE k % 17 <> 0
UNION ALL SELECT subject_id, k, 'linkedin_search', 'q', {_items(_item("Profile", "k + 3"))}, CAST(NULL AS string) FROM people
UNION ALL SELECT subject_id, k, 'google_search', 'q', {_items(_item("Mention", "k"))}, CASE WHEN k % 9 = 0 THEN 'timeout' END FROM people WHERE k % 4 <> 0
"""
_TITLE = derived._TITLE.format(x="(k * 7 + 3)")
SITES = f"""
SELECT subject_id, k, url, '<html><body><a href="/about/leadership">Leadership team</a> <a href="/x">x</a></body></html>' AS html, CASE WHEN k % 37 = 0 AND k > 1000 THEN 'HTTP 500' END AS error FROM people WHERE url IS NOT NULL
UNION ALL SELECT subject_id, k, url || '/about/leadership', CASE WHEN k % 46 = 0 THEN '<![x[ broken' ELSE '' END || '<html><body><div class="team-member"><h3>' || first_name || ' ' || last_name || '</h3><p class="title">' || {_TITLE} || '</p></div></body></html>', CAST(NULL AS string)
 FROM people WHERE url IS NOT NULL AND first_name IS NOT NULL AND k % 2 = 0
"""
PAGES = f"""
SELECT {_page("k")} AS url, k, CASE WHEN k % 41 = 0 THEN '<![x[ broken' ELSE '' END || '<html><head><title>' || title || '</title></head><body><p>' || body || '</p></body></html>' AS html FROM news
"""


def _landed(spark, d) -> Landed:
    own = lambda sql: derived.frame(spark, d, sql, derived.PEOPLE)
    news = derived.frame(spark, d, derived.ANNOUNCEMENTS)
    return Landed(own(PAYLOADS), own(SITES), spark.sql(PAGES.replace("FROM news", "FROM {news}"), news=news))


def _registry(spark):
    return spark.createDataFrame([(p, list(phases), priority) for p, phases, priority, *_ in REGISTRY], "provider_id string, phases array<string>, priority int")


PROFILE = providers.CoordinationProfile(providers={p: {"fallback_only": f, "enabled": e} for p, _, _, f, e in REGISTRY})


def _history(spark, d):
    return record_queries.people(spark, d).where("k % 11 = 0").select("subject_id", F.lit("google_search").alias("provider_id"), F.expr("TIMESTAMP '2024-05-20 00:00:00'").alias("last_run"))


def _health(spark):
    return spark.createDataFrame(list(BEGUN.items()), "provider_id string, consecutive_failures int")


# ---- the same in SQL -------------------------------------------------------------------------------------------------

_link = lambda k: f"SELECT subject_id, k, {_page(k)} AS url"
_TABLES = record_queries.WITH.split(", observed AS MATERIALIZED")[0] + f""", news AS MATERIALIZED ({derived.plain(derived.ANNOUNCEMENTS)}), payloads AS MATERIALIZED ({PAYLOADS.strip()}), sites AS MATERIALIZED ({SITES.strip()}),
 subj AS MATERIALIZED (SELECT k, subject_id, url FROM people WHERE first_name IS NOT NULL),
 rows_ AS (SELECT subject_id, provider_id, coalesce(error, CASE WHEN payload = 'no json' THEN '{evidence.UNREADABLE}' END) AS failed, CASE WHEN error IS NULL THEN (length(payload) - length(replace(payload, '"link"', ''))) // 6 ELSE 0 END AS n FROM payloads
  UNION ALL SELECT subject_id, 'company_website', error, CASE WHEN error IS NULL THEN 1 ELSE 0 END FROM sites),
 told AS MATERIALIZED (SELECT subject_id, provider_id, CASE WHEN count(failed) = count(*) THEN 'failure' WHEN count(failed) > 0 THEN 'partial' ELSE 'success' END AS status, CAST(sum(n) AS bigint) AS results, min(failed) AS error FROM rows_ GROUP BY ALL)"""


def _coordination() -> str:
    """Attempts, provider after provider, in the order in which they are settled."""
    out, parts, tracked = [], [], []
    late = "CAST(false AS boolean)"
    for phase in evidence.PHASES:
        own = sorted((x for x in REGISTRY if phase in x[1]), key=lambda x: (x[2], x[0]))
        for place, (p, phases, _, fallback, enabled) in enumerate(own, 1):
            name = f"{'search' if phase == 'search' else 'enrichment'}_{p}"
            stale = "(k % 11 <> 0)" if p == "google_search" else "true"
            at = f"k * 2 + {int(phase == 'company')}"
            earlier = " + ".join(f"coalesce((SELECT sum(results) FROM a_{q} x WHERE x.subject_id = s.subject_id AND skip IS NULL), 0)" for q in [f"{phase}_{y[0]}" for y in own[: place - 1]]) or "0"
            unneeded = f"({earlier}) > 0" if fallback else late
            wanted = f"SELECT s.subject_id, {at} AS pos, {stale} AS stale, {unneeded} AS late, coalesce(told.status IN ('success', 'partial'), false) AS ok, coalesce(told.status, 'failure') AS status, coalesce(results, 0) AS results, CASE WHEN told.status IS NULL THEN '{evidence.NOTHING}' ELSE told.error END AS error FROM subj s LEFT JOIN told ON told.subject_id = s.subject_id AND provider_id = '{p}'"
            out.append(f"w_{phase}_{p} AS MATERIALIZED ({wanted})")
            if name not in tracked:
                tracked.append(name)
                tries = [f"SELECT pos, ok FROM w_{phase}_{p} WHERE {str(enabled).lower()} AND stale AND NOT late"]
                if phase == "person" and "company" in phases:
                    tries.append(f"SELECT k * 2 + 1, coalesce(told.status IN ('success', 'partial'), false) FROM subj s LEFT JOIN told ON told.subject_id = s.subject_id AND provider_id = '{p}'")
                tries += [f"SELECT -{n}, false" for n in range(1, BEGUN.get(p, 0) + 1) if phase != "search"]
                out.append(f"d_{name} AS MATERIALIZED (SELECT min(pos) AS pos FROM (SELECT pos, NOT ok AND lag(NOT ok, 1, false) OVER (ORDER BY pos) AND lag(NOT ok, 2, false) OVER (ORDER BY pos) AS broke FROM ({' UNION ALL '.join(tries)})) WHERE broke)")
            skip = f"CASE WHEN NOT {str(enabled).lower()} THEN 'disabled' WHEN pos > coalesce((SELECT pos FROM d_{name}), pos) THEN 'unhealthy' WHEN NOT stale THEN 'not_stale' WHEN late THEN 'fallback_not_needed' END"
            out.append(f"a_{phase}_{p} AS MATERIALIZED (SELECT subject_id, '{phase}' AS phase, CAST({place} AS int) AS place, '{p}' AS provider_id, skip, CASE WHEN skip IS NULL THEN status END AS status, CASE WHEN skip IS NULL THEN results ELSE 0 END AS results, CASE WHEN skip IS NULL THEN error END AS error FROM (SELECT *, {skip} AS skip FROM w_{phase}_{p}))")
            parts.append(f"FROM a_{phase}_{p}")
    return ", ".join(out) + f", attempts AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_ATTEMPTS = _TABLES + ", " + _coordination()
_ran = lambda p, phase: f"EXISTS (SELECT 1 FROM attempts t WHERE t.subject_id = {{s}}.subject_id AND t.provider_id = '{p}' AND t.phase {phase} AND t.skip IS NULL)"
_by = {"press_release": ["k"], "google_web_search": ["k", "k + 1"], "news_search": ["k + 2"], "linkedin_search": ["k + 3"]}
_hits = " UNION ".join(f"{_link(k)}, {k} AS page FROM payloads p WHERE provider_id = '{p}' AND error IS NULL AND payload <> 'no json' AND length(payload) > 13 AND {_ran(p, chr(61) + chr(39) + 'search' + chr(39)).format(s='p')}" for p, ks in _by.items() for k in ks)
_facts = f"SELECT k, {_oracle_fact('n')} AS full_name, {_oracle_fact('r')} AS title, {_oracle_fact('c')} AS company_name, nullif(regexp_extract(body, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', 0), '') AS email, nullif(trim(regexp_extract(body, '\\+?\\d[\\d\\-.\\s()]{{7,}}\\d', 0)), '') AS phone FROM news"
_root_ok = "s.url IS NOT NULL AND NOT (s.k % 37 = 0 AND s.k > 1000)"
_web = _ran("company_website", "<> 'search'").format(s="s")
_SEEN = _ATTEMPTS + f""", hits AS MATERIALIZED ({_hits}), broken AS MATERIALIZED (SELECT DISTINCT subject_id FROM hits WHERE page % 41 = 0 AND page IN (SELECT k FROM news)), facts AS MATERIALIZED ({_facts}),
 read AS MATERIALIZED (SELECT h.subject_id, f.* FROM hits h JOIN facts f ON f.k = page WHERE h.subject_id NOT IN (FROM broken)),
 site AS MATERIALIZED (SELECT s.k, s.subject_id, first_name || ' ' || last_name AS full_name, {_TITLE.replace('(k *', '(s.k *')} AS title FROM subj s JOIN people USING (subject_id) WHERE s.k % 2 = 0 AND s.k % 46 <> 0 AND {_root_ok} AND {_web}),
 observed AS MATERIALIZED (SELECT subject_id, 'web_page' AS attribute, 'x' AS value, 'search_extraction' AS provider_id FROM read
  UNION ALL {' UNION ALL '.join(f"SELECT subject_id, '{a}', {a}, 'search_extraction' FROM read WHERE {a} IS NOT NULL" for a in ('full_name', 'title', 'company_name', 'email', 'phone'))}
  UNION ALL SELECT subject_id, 'web_mention', 'x', 'google_search' FROM payloads p WHERE provider_id = 'google_search' AND error IS NULL AND {_ran('google_search', "<> 'search'").format(s='p')}
  UNION ALL SELECT subject_id, 'full_name', full_name, 'company_website' FROM site UNION ALL SELECT subject_id, 'title', title, 'company_website' FROM site UNION ALL SELECT subject_id, 'source_page', 'x', 'company_website' FROM site),
 fetched AS (SELECT s.subject_id, CASE WHEN {_root_ok} AND {_web} THEN 1 + CAST(s.k % 2 = 0 AS int) ELSE 0 END AS n FROM subj s)"""


def _evidence(spark, d):
    p = record_queries.people(spark, d).where("first_name is not null")
    return evidence.collect(p.select("subject_id", F.col("k").alias("seq"), "url"), _registry(spark), _landed(spark, d), F.expr(_RUN), PROFILE, _history(spark, d), _health(spark))


def _attempts(spark, d):
    p = record_queries.people(spark, d).where("first_name is not null")
    return evidence.coordinate(p.select("subject_id", F.col("k").alias("seq")), _registry(spark), PROFILE, evidence.answers(_landed(spark, d)), F.expr(_RUN), _history(spark, d), _health(spark))


QUERIES["run_attempts"] = _attempts
SQL["run_attempts"] = _ATTEMPTS + " SELECT subject_id, phase, place, provider_id, skip, status, results, error FROM attempts"
QUERIES["run_coordination"] = lambda spark, d: _attempts(spark, d).groupBy("phase", "provider_id").agg(F.count("*").alias("considered"), F.count_if(F.col("skip").isNull()).alias("executed"), *[F.count_if(F.col("skip") == x).alias(x) for x in ("disabled", "unhealthy", "not_stale", "fallback_not_needed")], F.count_if(F.col("status") == "failure").alias("failed"), F.sum("results").alias("results"))
SQL["run_coordination"] = _ATTEMPTS + " SELECT phase, provider_id, count(*) AS considered, count(CASE WHEN skip IS NULL THEN 1 END) AS executed, " + ", ".join(f"count(CASE WHEN skip = '{x}' THEN 1 END) AS {x}" for x in ("disabled", "unhealthy", "not_stale", "fallback_not_needed")) + ", count(CASE WHEN status = 'failure' THEN 1 END) AS failed, CAST(sum(results) AS bigint) AS results FROM attempts GROUP BY ALL"
QUERIES["run_observations"] = lambda spark, d: _evidence(spark, d).observations.where(F.col("attribute").isin(*(a for _, _, _, a in R.COMPARED))).select("subject_id", "provider_id", "attribute", "value")
SQL["run_observations"] = _SEEN + f" SELECT subject_id, provider_id, attribute, value FROM observed WHERE attribute IN ({', '.join(repr(a) for _, _, _, a in R.COMPARED)})"


def _processed(spark, d):
    p, held = record_queries.people(spark, d), record_queries.stored(spark, d)
    none = {"title": "string", "company": "string", "url": "string", "last_inflection_type": "string", "last_inflection_confidence": "double", "last_inflection_explanation": "string", "last_inflection_detected_at": "timestamp", "created_at": "timestamp", "updated_at": "timestamp"}
    held = held.select("subject_id", "name", "email", "phone", "duns_number", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return subjects.process_landed(p, "subject_id", "k", _registry(spark), _landed(spark, d), held, F.expr(_RUN), coordination=PROFILE, history=_history(spark, d), health=_health(spark), profile=record_queries._EXACT)


_shown = ("subject_id", "executive_name", "providers_executed", "company_website_results_found", "google_results_found", "pages_fetched", "results_seen", "inflections_detected", "status", "errors")
_OUTCOME = record_queries._events + f""", state AS MATERIALIZED (SELECT subject_id, k, nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS name, subject_id IN (SELECT subject_id FROM observed) AS seen FROM people)
 SELECT subject_id, name AS executive_name, CASE WHEN name IS NULL THEN '' ELSE coalesce((SELECT string_agg(provider_id, ',' ORDER BY CASE phase WHEN 'person' THEN 1 WHEN 'company' THEN 2 ELSE 3 END, place) FROM attempts a WHERE a.subject_id = state.subject_id AND skip IS NULL), '') END AS providers_executed,
 (SELECT count(*) FROM observed o WHERE o.subject_id = state.subject_id AND provider_id = 'company_website') AS company_website_results_found, (SELECT count(*) FROM observed o WHERE o.subject_id = state.subject_id AND provider_id = 'google_search') AS google_results_found,
 CAST(coalesce((SELECT n FROM fetched f WHERE f.subject_id = state.subject_id), 0) AS bigint) AS pages_fetched, (SELECT count(*) FROM hits h WHERE h.subject_id = state.subject_id AND state.name IS NOT NULL) AS results_seen,
 CASE WHEN NOT seen OR name IS NULL THEN 'not_detected' ELSE coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM events e WHERE e.ref = state.subject_id), 'none') END AS inflections_detected,
 CASE WHEN name IS NULL THEN 'failed' WHEN subject_id IN (FROM broken) THEN 'partial' ELSE 'success' END AS status,
 CASE WHEN name IS NULL THEN '{subjects.NO_NAME}' WHEN subject_id IN (FROM broken) THEN 'Search extraction failed: unknown status keyword ''x'' in marked section' ELSE '' END AS errors FROM state"""
QUERIES["process_landed"] = lambda spark, d: _processed(spark, d)[0].reports.select(*_shown)
SQL["process_landed"] = _SEEN + _OUTCOME
