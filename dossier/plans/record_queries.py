"""Named queries over identities, comparisons, inflections, providers, storage and reports, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions.cut import shared_folder
from dossier.operators import comparison, evaluation, identity, inflection, providers, simulation, storage, subjects, versions
from dossier.plans import derived

QUERIES, SQL = {}, {}
_RUN = "TIMESTAMP '2024-06-01 00:00:00'"
WITH = f"WITH people AS MATERIALIZED ({derived.plain(derived.PEOPLE)}), stored AS MATERIALIZED ({derived.STORED.strip()}), observed AS MATERIALIZED ({derived.OBSERVED.strip()})"


def people(spark, d):
    return derived.frame(spark, d, derived.PEOPLE)


def stored(spark, d):
    return derived.frame(spark, d, derived.STORED, derived.PEOPLE)


def observed(spark, d):
    return derived.frame(spark, d, derived.OBSERVED, derived.PEOPLE)


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ---- identity ---------------------------------------------------------------------------------------------

_signals = """, signals AS MATERIALIZED (SELECT * FROM (
 SELECT subject_id AS ref, 0 AS position, 'email_exact' AS signal_type, lower(trim(email)) AS value, 'moderate' AS tier FROM people
 UNION ALL SELECT subject_id, 1, 'full_name', lower(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))), 'weak' FROM people
 UNION ALL SELECT subject_id, 2, 'phone', lower(trim(phone)), 'weak' FROM people
 UNION ALL SELECT subject_id, 3, 'title', lower(trim(title)), 'weak' FROM people) WHERE value <> ''),
 held AS MATERIALIZED (SELECT * FROM (
 SELECT subject_id AS identity_id, 'email_exact' AS signal_type, lower(trim(email)) AS value FROM stored
 UNION ALL SELECT subject_id, 'full_name', lower(trim(name)) FROM stored
 UNION ALL SELECT subject_id, 'phone', lower(trim(phone)) FROM stored
 UNION ALL SELECT subject_id, 'duns_number', lower(trim(duns_number)) FROM stored) WHERE value <> ''),
 pairs AS MATERIALIZED (SELECT ref, identity_id FROM (SELECT ref, identity_id, row_number() OVER (PARTITION BY ref ORDER BY identity_id) AS nth
  FROM (SELECT DISTINCT ref, identity_id FROM signals JOIN held USING (signal_type, value) WHERE signal_type <> 'title')) WHERE nth <= 25),
 raw AS MATERIALIZED (SELECT ref, identity_id, coalesce(sum(CASE WHEN h.value = s.value THEN CASE signal_type WHEN 'email_exact' THEN 50 WHEN 'full_name' THEN 15 WHEN 'phone' THEN 12 ELSE 5 END END), 0) AS plus,
  count(CASE WHEN h.value = s.value THEN 1 END) AS agree, count(CASE WHEN h.value <> s.value AND signal_type = 'email_exact' THEN 1 END) AS against,
  coalesce(string_agg(CASE WHEN h.value = s.value THEN signal_type END, ', ' ORDER BY position), 'none') AS supporting
  FROM pairs JOIN signals s USING (ref) LEFT JOIN held h USING (identity_id, signal_type) GROUP BY ALL),
 scored AS MATERIALIZED (SELECT ref, identity_id, CASE WHEN agree < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, (plus - 35 * against) / 100.0)) END AS score, agree, against, supporting FROM raw),
 banded AS MATERIALIZED (SELECT *, CASE WHEN agree < 2 OR round(score, 6) < 0.55 THEN 'no_match' WHEN round(score, 6) >= 0.90 THEN 'auto_merge' ELSE 'candidate_review' END AS band FROM scored)"""
_decided = _signals + """, decided AS MATERIALIZED (SELECT ref, CASE WHEN bool_or(band = 'auto_merge') THEN 'auto_merge' WHEN bool_or(band = 'candidate_review') THEN 'candidate_review' ELSE 'new_identity' END AS decision, count(identity_id) AS candidates
 FROM (SELECT subject_id AS ref FROM people) LEFT JOIN banded USING (ref) GROUP BY ref)"""


def _resolved(spark, d):
    return identity.resolve(people(spark, d), "subject_id", identity.stored_signals(stored(spark, d)))


@query("id_signals", WITH + _signals + " SELECT ref, signal_type, value, tier FROM signals")
def _(spark, d):
    return _resolved(spark, d)["signals"].select("ref", "signal_type", "value", "tier")


@query("id_company_signals", WITH + """ SELECT * FROM (SELECT subject_id AS ref, 'duns_number' AS signal_type, duns_number AS value FROM people
 UNION ALL SELECT subject_id, 'company_domain_and_name', lower(regexp_extract(email, '@([\\w.-]+\\.\\w+)', 1) || '|' || company_name) FROM people WHERE email IS NOT NULL
 UNION ALL SELECT subject_id, 'company_name_city', lower(company_name || '|' || city) FROM people) WHERE value IS NOT NULL""")
def _(spark, d):
    return identity.company_signals(people(spark, d).withColumn("company_email", F.col("email")), "subject_id").select("ref", "signal_type", "value")


@query("id_candidates_blocked", WITH + _signals + " SELECT ref, identity_id FROM pairs")
def _(spark, d):
    return _resolved(spark, d)["pairs"].select("ref", "identity_id")


@query("id_pair_scores", WITH + _signals + " SELECT ref, identity_id, round(score, 6) AS score, band, supporting, CAST(against AS bigint) AS against FROM banded")
def _(spark, d):
    s = F.when(F.size("supporting") == 0, "none").otherwise(F.array_join("supporting", ", "))
    return _resolved(spark, d)["pairs"].select("ref", "identity_id", F.round("score", 6).alias("score"), "band", s.alias("supporting"), F.size("contradicting").cast("long").alias("against"))


@query("id_decisions", WITH + _decided + " SELECT ref, decision, candidates FROM decided")
def _(spark, d):
    return _resolved(spark, d)["outcomes"].select("ref", "decision", "candidates")


@query("id_review_queue", WITH + _decided + " SELECT ref, CAST(row_number() OVER (PARTITION BY ref ORDER BY round(score, 6) DESC, identity_id) - 1 AS int) AS rank, identity_id, 'open' AS status FROM banded JOIN decided USING (ref) WHERE decision = 'candidate_review' AND band = 'candidate_review'")
def _(spark, d):
    return _resolved(spark, d)["review_queue"]


@query("id_metrics", WITH + _decided + " SELECT count(*) AS records, count(CASE WHEN decision = 'auto_merge' THEN 1 END) AS auto_merge, count(CASE WHEN decision = 'candidate_review' THEN 1 END) AS candidate_review, count(CASE WHEN decision = 'new_identity' THEN 1 END) AS new_identity, CAST(sum(candidates) AS bigint) AS candidates, (SELECT count(*) FROM signals) AS signals FROM decided")
def _(spark, d):
    r = _resolved(spark, d)
    return identity.metrics(r["signals"], r["outcomes"])


@query("id_recompute", WITH + _signals + " SELECT ref, identity_id, band AS band_before, band AS band_after FROM banded WHERE band = 'candidate_review'")
def _(spark, d):
    r = _resolved(spark, d)
    queue = r["pairs"].where("band = 'candidate_review'")
    return identity.recompute(queue, r["signals"], identity.stored_signals(stored(spark, d))).select("ref", "identity_id", "band_before", "band_after")


# ---- comparison --------------------------------------------------------------------------------------------

_s = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_c = lambda x: f"lower({_s(f'''regexp_replace({x}, '\\s+', ' ', 'g')''')})"
_k = lambda f, x: f"CASE {f} WHEN 'email' THEN lower({_s(x)}) WHEN 'phone' THEN CASE WHEN starts_with({_s(x)}, '+') THEN '+' ELSE '' END || regexp_replace({x}, '\\D', '', 'g') ELSE {_c(x)} END"
_compare = f""", had AS MATERIALIZED (SELECT subject_id AS ref, unnest([0, 1, 2, 3, 4]) AS position, unnest(['name', 'title', 'company', 'email', 'phone']) AS field,
 unnest([nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), title, company_name, email, phone]) AS existing FROM people),
 spelt AS MATERIALIZED (SELECT subject_id AS ref, CASE attribute WHEN 'full_name' THEN 'name' WHEN 'company_name' THEN 'company' ELSE attribute END AS field, {_s("value")} AS raw FROM observed),
 found AS MATERIALIZED (SELECT ref, field, list(raw ORDER BY raw) AS found FROM (SELECT ref, field, min(raw) AS raw FROM spelt WHERE raw <> '' GROUP BY ref, field, {_k("field", "raw")}) GROUP BY ref, field),
 compared AS MATERIALIZED (SELECT ref, position, field, existing, CASE WHEN len(found) = 1 THEN found[1] END AS new,
 CASE WHEN existing IS NULL AND found IS NULL THEN 'unknown' WHEN len(found) > 1 THEN 'conflict' WHEN found IS NULL THEN 'missing' WHEN existing IS NULL THEN 'new'
  WHEN {_k("field", "existing")} = {_k("field", "found[1]")} THEN 'match' ELSE 'changed' END AS status, found FROM had LEFT JOIN found USING (ref, field)),
 summed AS MATERIALIZED (SELECT ref, count(CASE WHEN status = 'match' THEN 1 END) AS "match", count(CASE WHEN status = 'changed' THEN 1 END) AS changed, count(CASE WHEN status = 'missing' THEN 1 END) AS missing,
 count(CASE WHEN status = 'new' THEN 1 END) AS "new", count(CASE WHEN status = 'conflict' THEN 1 END) AS conflict, count(CASE WHEN status = 'unknown' THEN 1 END) AS unknown FROM compared GROUP BY ref),
 sure AS MATERIALIZED (SELECT *, CASE WHEN unknown < 5 THEN ("match" + changed + missing + "new") / (5 - unknown) ELSE 0.0 END AS confidence FROM summed)"""


def _verdicts(spark, d, fuzzy=False):
    return comparison.verdicts(people(spark, d), "subject_id", observed(spark, d), fuzzy=fuzzy)


@query("cmp_new_values", WITH + _compare + " SELECT ref, field, array_to_string(found, '|') AS found FROM found")
def _(spark, d):
    return comparison.new_values(observed(spark, d)).withColumn("found", F.array_join("found", "|"))


@query("cmp_verdicts_exact", WITH + _compare + " SELECT ref, field, existing, new, status, CASE WHEN status = 'conflict' THEN array_to_string(found, '|') END AS conflicting FROM compared")
def _(spark, d):
    return _verdicts(spark, d).select("ref", "field", "existing", "new", "status", F.array_join("conflicting", "|").alias("conflicting"))


@query("cmp_summary", WITH + _compare + " SELECT ref, \"match\", changed, missing, \"new\", conflict, unknown, round(confidence, 6) AS confidence FROM sure")
def _(spark, d):
    return comparison.summaries(_verdicts(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("cmp_change_list", WITH + _compare + " SELECT ref, coalesce(string_agg(CASE WHEN status = 'changed' THEN field || ': ' || existing || ' -> ' || new END, '; ' ORDER BY position), '') AS changes FROM compared GROUP BY ref")
def _(spark, d):
    return comparison.change_list(_verdicts(spark, d))


#: The same with difflib's ratio, as SQL: the longest common part of two texts (of equal ones the first in the old text, then in
#: the new one), and so on left and right of it.
_fuzzy = {f: t for f, kind, t, _ in R.COMPARED if kind == "fuzzy"}
_ratio = f""", fz_hard AS MATERIALIZED (SELECT DISTINCT {_c("existing")} AS a, {_c("found[1]")} AS b FROM had JOIN found USING (ref, field) WHERE field IN ({", ".join(repr(f) for f in _fuzzy)}) AND existing IS NOT NULL AND len(found) = 1),
 fz_step(a, b, alo, ahi, blo, bhi, m) AS (SELECT a, b, CAST(0 AS bigint), CAST(length(a) AS bigint), CAST(0 AS bigint), CAST(length(b) AS bigint), CAST(0 AS bigint) FROM fz_hard WHERE a <> b
  UNION ALL SELECT * FROM (SELECT a, b, unnest([alo, x.i + x.k]) AS alo, unnest([x.i, ahi]) AS ahi, unnest([blo, x.j + x.k]) AS blo, unnest([x.j, bhi]) AS bhi, unnest([x.k, 0]) AS m FROM (
   SELECT a, b, alo, ahi, blo, bhi, min_by(struct_pack(i := i, j := j, k := k), struct_pack(nk := -k, i := i, j := j)) AS x FROM (
    SELECT a, b, alo, ahi, blo, bhi, i, j, unnest(range(1, least(ahi - i, bhi - j) + 1)) AS k FROM (SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT a, b, alo, ahi, blo, bhi, unnest(range(alo, ahi)) AS i FROM fz_step WHERE ahi > alo AND bhi > blo))
   ) WHERE substr(a, i + 1, k) = substr(b, j + 1, k) GROUP BY ALL))),
 fz_ratio AS MATERIALIZED (SELECT a, b, CAST(2 * sum(m) AS double) / (length(a) + length(b)) AS ratio FROM fz_step GROUP BY a, b)"""
_same_key = f'{_k("field", "existing")} = {_k("field", "found[1]")}'
_likeness = f"CASE WHEN existing IS NOT NULL AND len(found) = 1 THEN CASE WHEN {_same_key} THEN 1.0 ELSE coalesce(ratio, 0.0) END END"
_limit = "CASE field " + " ".join(f"WHEN '{f}' THEN {t}" for f, t in _fuzzy.items()) + " ELSE 1.0 END"
_compare_fuzzy = _compare.replace(", compared AS MATERIALIZED", f"{_ratio},\n compared AS MATERIALIZED", 1) if ", compared AS MATERIALIZED" in _compare else _compare.replace(",\n compared AS MATERIALIZED", f"{_ratio},\n compared AS MATERIALIZED", 1)
_compare_fuzzy = _compare_fuzzy.replace(f"WHEN {_same_key} THEN 'match'", f"WHEN {_likeness} >= {_limit} THEN 'match'").replace("found FROM had LEFT JOIN found USING (ref, field))", f"found, CAST({_likeness} AS double) AS similarity FROM had LEFT JOIN found USING (ref, field) LEFT JOIN fz_ratio ON field IN ({', '.join(repr(f) for f in _fuzzy)}) AND a = {_c('existing')} AND b = {_c('found[1]')})")
_kind = "CASE WHEN field IN (" + ", ".join(repr(f) for f in _fuzzy) + ") THEN 'fuzzy' ELSE 'exact' END"
_told = f"""CASE status WHEN 'unknown' THEN 'No data available from either the existing record or new observations.' WHEN 'conflict' THEN len(found) || ' differing new value(s) found for this field: ' || array_to_string(found, ', ') || '.'
 WHEN 'missing' THEN 'Existing value present; no corresponding new observation was found.' WHEN 'new' THEN 'No existing value; a new observation provides one.'
 ELSE {_kind} || ' comparison: ' || CASE status WHEN 'match' THEN 'equivalent' ELSE 'differs' END || printf(' (score=%.3f).', similarity) END"""


def fuzzy_sql(sql: str) -> str:
    """A query over exact comparisons with the fuzzy ones in their place."""
    assert _compare in sql
    return sql.replace(_compare, _compare_fuzzy, 1).replace("WITH ", "WITH RECURSIVE ", 1)


@query("cmp_status_fuzzy", fuzzy_sql(WITH + _compare) + " SELECT ref, field, status FROM compared")
def _(spark, d):
    return comparison.verdicts(people(spark, d), "subject_id", observed(spark, d), scores=False).select("ref", "field", "status")


@query("cmp_verdicts_fuzzy", fuzzy_sql(WITH + _compare) + f" SELECT ref, field, existing, new, status, CASE WHEN status IN ('match', 'changed') THEN round(similarity, 6) END AS similarity, {_told} AS explanation FROM compared")
def _(spark, d):
    return _verdicts(spark, d, True).select("ref", "field", "existing", "new", "status", F.round("similarity", 6).alias("similarity"), "explanation")


# ---- inflections --------------------------------------------------------------------------------------------

_order = sorted(R.SENIORITY, key=lambda x: (-len(x[0]), -x[1]))
_rank = lambda x: "CASE " + " ".join(f"WHEN contains(lower(trim({x})), '{k}') THEN {r}" for k, r in _order) + " END"
_events = _compare + f""", wide AS MATERIALIZED (SELECT ref, {", ".join(f"max(CASE WHEN field = '{f}' THEN {c} END) AS {f}_{c}" for f in ("name", "title", "company", "email", "phone") for c in ("status", "existing", "new"))} FROM compared GROUP BY ref),
 flags AS MATERIALIZED (SELECT wide.*, confidence, {_rank("title_existing")} AS r0, {_rank("title_new")} AS r1, (title_status = 'changed' OR company_status = 'changed' OR email_status = 'changed' OR phone_status = 'changed') AS confirmed FROM wide JOIN sure USING (ref)),
 events AS MATERIALIZED ({" UNION ALL ".join(f"SELECT ref, {n} AS position, '{rid}' AS rule_id, '{kind}' AS type, {base} * confidence AS confidence FROM flags WHERE {when}" for n, ((rid, kind, base), when) in enumerate(zip(R.INFLECTIONS, (
    "title_status = 'changed' AND r1 > r0", "title_status = 'changed' AND r1 < r0", "company_status = 'changed'",
    "title_status = 'missing' AND name_status <> 'missing' AND NOT confirmed", "email_status = 'changed' OR phone_status = 'changed'", "name_status = 'new'", "name_status = 'missing' AND NOT confirmed"))))}),
 top AS MATERIALIZED (SELECT ref, arg_max(type, confidence * 1000 - position) AS type FROM (SELECT ref, type, round(confidence, 6) AS confidence, position FROM events) GROUP BY ref)"""


def _found(spark, d):
    v = _verdicts(spark, d)
    return v, inflection.detect(v)


@query("infl_seniority", WITH + f" SELECT subject_id, title, {_rank('title')} AS rank FROM people")
def _(spark, d):
    return people(spark, d).select("subject_id", "title", inflection.seniority(F.col("title")).alias("rank"))


@query("infl_events", WITH + _events + " SELECT ref, rule_id, type, round(confidence, 6) AS confidence FROM events")
def _(spark, d):
    return _found(spark, d)[1].select("ref", "rule_id", "type", F.round("confidence", 6).alias("confidence"))


@query("infl_strongest", WITH + _events + " SELECT ref, type FROM top")
def _(spark, d):
    return inflection.strongest(_found(spark, d)[1].withColumn("confidence", F.round("confidence", 6))).select("ref", "type")


_fill = lambda t: "'" + t.replace("'", "''").replace("{name}", "' || coalesce(name, '') || '").replace("{company}", f"' || coalesce(company, '{R.UNKNOWN_COMPANY}') || '").replace("{title}", f"' || coalesce(title, '{R.UNKNOWN_TITLE}') || '") + "'"
_now = ", ".join(f"CASE WHEN {f}_status IN ('changed', 'new') THEN {f}_new ELSE {f}_existing END AS {f}" for f in ("name", "title", "company"))


@query("infl_messages", WITH + _events + f", cur AS (SELECT ref, {_now} FROM wide) SELECT ref, type, CASE type " + " ".join(f"WHEN '{k}' THEN {_fill(t)}" for k, t in R.MESSAGES.items()) + " END AS message FROM top JOIN cur USING (ref)")
def _(spark, d):
    v, e = _found(spark, d)
    return inflection.messages(e.withColumn("confidence", F.round("confidence", 6)), v)


@query("infl_by_segment", WITH + _events + " SELECT segment, type, count(*) AS events, count(DISTINCT ref) AS subjects FROM events JOIN people ON ref = subject_id GROUP BY segment, type")
def _(spark, d):
    e = _found(spark, d)[1].join(people(spark, d).select(F.col("subject_id").alias("ref"), "segment"), "ref")
    return e.groupBy("segment", "type").agg(F.count("*").alias("events"), F.countDistinct("ref").alias("subjects"))


@query("inflection_counts", WITH + _events + " SELECT type, count(*) AS events, count(DISTINCT ref) AS subjects FROM events GROUP BY type")
def _(spark, d):
    return evaluation.inflection_counts(_found(spark, d)[1])


# ---- storage ------------------------------------------------------------------------------------------------

_people_row = "subject_id, nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS name, title, company_name AS company, email, phone, duns_number, url"


def _table(spark, d):
    """A stored version of two thirds of the people, with ids as in records."""
    p = people(spark, d).where("k % 3 <> 0").selectExpr(*[x.strip() for x in ("subject_id", "nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS name", "title", "company_name AS company", "email", "phone", "duns_number", "url")])
    none = {"last_inflection_type": "string", "last_inflection_confidence": "double", "last_inflection_explanation": "string", "last_inflection_detected_at": "timestamp"}
    return p.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("created_at"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("updated_at"))


@query("store_baseline_insert", WITH + f" SELECT {_people_row} FROM people WHERE k % 3 = 0")
def _(spark, d):
    p = people(spark, d).selectExpr("subject_id", "nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS name", "title", "company_name AS company", "email", "phone", "duns_number", "url")
    return storage.baseline_insert(_table(spark, d), p, F.expr(_RUN)).select("subject_id", "name", "title", "company", "email", "phone", "duns_number", "url")


_new = lambda f: f"CASE WHEN {f}_status IN ('changed', 'new') THEN {f}_new END"
_fields = ("name", "title", "company", "email", "phone")


@query("store_apply_changes", WITH + _events + f", base AS (SELECT {_people_row} FROM people WHERE k % 3 <> 0) SELECT subject_id, " + ", ".join(f"coalesce({_new(f)}, {f}) AS {f}" for f in _fields) + ", type AS last_inflection_type, CAST(" + " + ".join(f"CAST({_new(f)} IS NOT NULL AS int)" for f in _fields) + f" AS int) AS fields_updated FROM base JOIN wide ON ref = subject_id LEFT JOIN top USING (ref)")
def _(spark, d):
    v, e = _found(spark, d)
    best = inflection.strongest(e.withColumn("confidence", F.round("confidence", 6)))
    return storage.apply_changes(_table(spark, d), v, best, v.select("ref"), F.expr(_RUN)).select("subject_id", *_fields, "last_inflection_type", "fields_updated")


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))


_latest = "SELECT o_custkey AS subject, o_orderdate AS at, o_orderkey AS id, o_orderstatus AS state FROM orders {where} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query("snapshot_latest", _latest.format(where=""))
def _(spark, d):
    return storage.latest(_orders(spark, d), ["subject"], "at")


@query("snapshot_as_of", _latest.format(where="WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00'"))
def _(spark, d):
    return storage.as_of(_orders(spark, d), ["subject"], "at", F.expr("TIMESTAMP '1996-01-01 00:00:00'"))


@query("snapshot_history", "SELECT o_custkey AS subject, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS int) AS nth FROM orders")
def _(spark, d):
    return storage.history(_orders(spark, d), ["subject"], "at").select("subject", "id", "nth")


# Orders as a table in versions: a commit a year, each customer's last order of it; one that is still pending removes the customer.
_versions = """WITH years AS (SELECT CAST(y AS int) AS year, CAST(y - (SELECT min(year(o_orderdate)) FROM orders) + 1 AS int) AS version FROM range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 1) x(y)),
 written AS (SELECT o_custkey AS subject, o_orderdate AS at, o_orderkey AS id, o_orderstatus AS state, version FROM orders JOIN years ON year(o_orderdate) = year QUALIFY row_number() OVER (PARTITION BY o_custkey, version ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _versioned(spark, d, upto=None):
    """The table, and the number of its version after `upto` commits, opened before those that follow."""
    table = versions.Table(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", ["subject"])
    o = _orders(spark, d)
    first, last = o.agg(F.min(F.year("at")), F.max(F.year("at"))).first()
    opened, number = None, 0
    for k, year in enumerate(range(first, last + 1), 1):
        rows = storage.latest(o.where(F.year("at") == year), ["subject"], "at")
        number = table.commit(rows, number, gone=F.col("state") == "P", note=str(k))
        if k == 3:
            number = table.compact()
        if k == upto:
            opened = table.read()
    return table, opened


@query("version_pinned", _versions + ' SELECT subject, "at", id, state FROM (SELECT * FROM written WHERE version <= 5 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY version DESC) = 1) WHERE state <> \'P\'')
def _(spark, d):
    return _versioned(spark, d, 5)[1]


@query("version_history", _versions + " SELECT subject, id, state = 'P' AS gone, CAST(row_number() OVER (PARTITION BY subject ORDER BY version) AS int) AS nth, lag(id) OVER (PARTITION BY subject ORDER BY version) AS before FROM written")
def _(spark, d):
    rows = storage.history(_versioned(spark, d)[0].history(), ["subject"], "_version")
    return rows.select("subject", "id", F.col("_gone").alias("gone"), "nth", F.lag("id").over(Window.partitionBy("subject").orderBy("_version")).alias("before"))


@query("evidence_since", "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND event_type = 'view'")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    start = events.agg(F.min("ts").alias("t")).first()["t"]
    return storage.since(events, "ts", F.lit(start) + F.expr("INTERVAL 1 DAY"), event_type="view").select("event_id", "user_id", "event_type")


# ---- reports ---------------------------------------------------------------------------------------------------

_report = _events + """, report AS MATERIALIZED (SELECT subject_id, nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS executive_name, company_name AS company, url AS website_searched,
 CASE WHEN k % 2 = 0 THEN 'company_website,google_search' ELSE 'company_website' END AS providers_executed,
 (SELECT count(*) FROM observed o WHERE o.subject_id = p.subject_id AND provider_id = 'company_website') AS company_website_results_found,
 (SELECT count(*) FROM observed o WHERE o.subject_id = p.subject_id AND provider_id = 'google_search') AS google_results_found,
 printf('matched=%d changed=%d missing=%d new=%d conflict=%d unknown=%d confidence=%.2f', "match", changed, missing, "new", conflict, unknown, confidence) AS comparison_summary,
 CASE WHEN NOT EXISTS (SELECT 1 FROM observed o WHERE o.subject_id = p.subject_id) THEN 'not_detected' ELSE coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM events e WHERE e.ref = p.subject_id), 'none') END AS inflections_detected,
 CASE WHEN k % 6 = 0 AND email IS NOT NULL THEN CASE WHEN k % 12 = 0 THEN 'valid' ELSE 'invalid' END WHEN email IS NULL THEN 'no_email' WHEN k % 11 = 0 THEN 'error' ELSE 'not_configured' END AS verification_status,
 CASE WHEN k % 11 = 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN k % 11 = 0 THEN 'Enrichment (person) failed; Verification failed' ELSE '' END AS errors
 FROM people p JOIN sure ON ref = subject_id)"""


def _rows(spark, d):
    p, o = people(spark, d), observed(spark, d)
    v, e = _found(spark, d)
    seen = o.select("subject_id").distinct().withColumn("has_observations", F.lit(True))
    name = F.nullif(F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))), F.lit(""))
    ran = F.when(F.col("k") % 2 == 0, F.array(F.lit("company_website"), F.lit("google_search"))).otherwise(F.array(F.lit("company_website")))
    errors = F.when(F.col("k") % 11 == 0, F.array(F.lit("Enrichment (person) failed"), F.lit("Verification failed"))).otherwise(F.array().cast("array<string>"))
    subjects = p.join(seen, "subject_id", "left").select("subject_id", name.alias("executive_name"), F.col("company_name").alias("company"), "email", "url", F.coalesce("has_observations", F.lit(False)).alias("has_observations"), ran.alias("providers"), errors.alias("errors"))
    verified = p.where("k % 6 = 0 and email is not null").select("subject_id", F.when(F.col("k") % 12 == 0, "valid").otherwise("invalid").alias("status"))
    return evaluation.rows(subjects, o, comparison.summaries(v), e, verified)


@query("eval_rows", WITH + _report + " SELECT * FROM report")
def _(spark, d):
    return _rows(spark, d)


_has = lambda c, v: f"list_contains(string_split({c}, ','), '{v}')"
_counted = "verification_status NOT IN ('no_email', 'not_configured', 'error')"


@query("eval_summary", WITH + _report + f" SELECT count(*) AS total_executives_processed, round(count(CASE WHEN status = 'success' THEN 1 END) / count(*) * 100, 6) AS success_rate, count(CASE WHEN contains(errors, 'Enrichment (') THEN 1 END) AS failed_searches, count(CASE WHEN company_website_results_found > 0 THEN 1 END) AS company_websites_found, count(CASE WHEN {_has('providers_executed', 'google_search')} THEN 1 END) AS google_searches_completed, count(CASE WHEN {_has('inflections_detected', 'promotion')} THEN 1 END) AS promotions_detected, count(CASE WHEN {_has('inflections_detected', 'company_change')} THEN 1 END) AS company_changes_detected, count(CASE WHEN {_has('inflections_detected', 'executive_no_longer_found')} THEN 1 END) AS missing_executives, round(count(CASE WHEN {_counted} AND {_has('verification_status', 'valid')} THEN 1 END) / count(CASE WHEN {_counted} THEN 1 END) * 100, 6) AS verification_success_rate FROM report")
def _(spark, d):
    return evaluation.summary(_rows(spark, d)).withColumns({c: F.round(c, 6) for c in ("success_rate", "verification_success_rate")})


@query("run_summary", WITH + _report + " SELECT count(*) AS subjects, count(CASE WHEN status = 'success' THEN 1 END) AS success, count(CASE WHEN status = 'partial' THEN 1 END) AS partial, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, CAST(coalesce(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END), 0) AS bigint) AS errors FROM report")
def _(spark, d):
    return evaluation.batch_statistics(_rows(spark, d))


# ---- whole runs --------------------------------------------------------------------------------------------------

#: The same comparison without difflib, which SQL has not.
_EXACT = comparison.ComparisonProfile(tuple((f, "exact", None, a) for f, _, _, a in R.COMPARED))
_run = _decided + _events + f""", state AS MATERIALIZED (SELECT subject_id, k, nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), '') AS name, company_name, k % 13 = 0 AS broken,
 subject_id IN (SELECT subject_id FROM observed) AS seen FROM people),
 felt AS MATERIALIZED (SELECT events.* FROM events JOIN state ON ref = subject_id WHERE seen AND NOT broken AND name IS NOT NULL),
 best AS MATERIALIZED (SELECT ref, arg_max(type, round(confidence, 6) * 1000 - position) AS type FROM felt GROUP BY ref), cur AS (SELECT ref, {_now} FROM wide),
 said AS MATERIALIZED (SELECT ref, CASE type {" ".join(f"WHEN '{k}' THEN {_fill(t)}" for k, t in R.MESSAGES.items())} END AS message FROM best JOIN cur USING (ref)),
 status AS MATERIALIZED (SELECT state.*, CASE WHEN name IS NULL OR broken THEN 'failed' WHEN k % 11 = 0 THEN 'partial' ELSE 'success' END AS status,
 CASE WHEN name IS NULL THEN '{subjects.NO_NAME}' ELSE concat_ws('; ', CASE WHEN k % 11 = 0 THEN 'Enrichment (person) failed: timeout' END, CASE WHEN broken THEN 'Comparison failed: broken' END) END AS errors,
 CASE WHEN name IS NOT NULL THEN decision END AS identity FROM state JOIN decided ON ref = subject_id)"""


def _processed(spark, d, profile=None):
    p, o = people(spark, d), observed(spark, d)
    failed = p.where("k % 11 = 0").select("subject_id", F.lit("Enrichment (person)").alias("stage"), F.lit("timeout").alias("error"))
    failed = failed.unionByName(p.where("k % 13 = 0").select("subject_id", F.lit("Comparison").alias("stage"), F.lit("broken").alias("error")))
    held = stored(spark, d)
    none = {"title": "string", "company": "string", "url": "string", "last_inflection_type": "string", "last_inflection_confidence": "double", "last_inflection_explanation": "string", "last_inflection_detected_at": "timestamp", "created_at": "timestamp", "updated_at": "timestamp"}
    held = held.select("subject_id", "name", "email", "phone", "duns_number", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return subjects.process(p, "subject_id", o, held, F.expr(_RUN), failures=failed, profile=profile), o


@query("process_subjects", WITH + _run + " SELECT subject_id, name AS executive_name, status, errors, identity, CASE WHEN NOT seen OR name IS NULL THEN 'not_detected' ELSE coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM felt WHERE felt.ref = subject_id), 'none') END AS inflections_detected, message FROM status LEFT JOIN said ON ref = subject_id")
def _(spark, d):
    return _processed(spark, d, _EXACT)[0].reports.select("subject_id", "executive_name", "status", "errors", "identity", "inflections_detected", "message")


_summed = """CASE WHEN name IS NULL OR broken THEN 'not_compared' ELSE printf('matched=%d changed=%d missing=%d new=%d conflict=%d unknown=%d confidence=%.2f', "match", changed, missing, "new", conflict, unknown, confidence) END"""


@query("process_subjects_fuzzy", fuzzy_sql(WITH + _run) + f" SELECT subject_id, name AS executive_name, status, errors, identity, {_summed} AS comparison_summary, CASE WHEN NOT seen OR name IS NULL THEN 'not_detected' ELSE coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM felt WHERE felt.ref = subject_id), 'none') END AS inflections_detected, message FROM status LEFT JOIN said ON said.ref = subject_id JOIN sure ON sure.ref = subject_id")
def _(spark, d):
    return _processed(spark, d)[0].reports.select("subject_id", "executive_name", "status", "errors", "identity", "comparison_summary", "inflections_detected", "message")


@query("run_report_full", WITH + _run + """ SELECT count(*) AS subjects, count(CASE WHEN status = 'success' THEN 1 END) AS success, count(CASE WHEN status = 'partial' THEN 1 END) AS partial, count(CASE WHEN status = 'failed' THEN 1 END) AS failed,
 CAST(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END) AS bigint) AS errors, (SELECT count(DISTINCT ref) FROM felt) AS subjects_with_inflections, (SELECT count(*) FROM said) AS messages,
 count(CASE WHEN identity = 'auto_merge' THEN 1 END) AS auto_merge, count(CASE WHEN identity = 'candidate_review' THEN 1 END) AS candidate_review, count(CASE WHEN identity = 'new_identity' THEN 1 END) AS new_identity,
 (SELECT count(*) FROM felt) AS inflections, (SELECT count(*) FROM observed) AS observations, (SELECT count(DISTINCT subject_id) FROM observed) AS subjects_with_evidence,
 (SELECT CAST(count(*) AS bigint) FROM compared JOIN state ON ref = subject_id WHERE status IN ('changed', 'new') AND new IS NOT NULL AND NOT broken AND name IS NOT NULL) AS fields_updated,
 round(count(CASE WHEN status = 'success' THEN 1 END) / count(*) * 100, 6) AS success_rate, round((SELECT count(DISTINCT ref) FROM felt) / count(*) * 100, 6) AS inflection_rate, round(count(CASE WHEN identity = 'auto_merge' THEN 1 END) / count(identity) * 100, 6) AS merge_rate FROM status""")
def _(spark, d):
    run, o = _processed(spark, d, _EXACT)
    return subjects.summary(run, o).withColumns({c: F.round(c, 6) for c in ("success_rate", "inflection_rate", "merge_rate")})


# ---- providers ---------------------------------------------------------------------------------------------------

_health = f"WITH attempts AS ({derived.plain(derived.ATTEMPTS)}), island AS (SELECT *, sum(CAST(ok AS int)) OVER (PARTITION BY provider_id ORDER BY seq) AS g FROM attempts), streak AS MATERIALIZED (SELECT provider_id, seq, ok, CAST(sum(CAST(NOT ok AS int)) OVER (PARTITION BY provider_id, g ORDER BY seq) AS bigint) AS n FROM island)"


def _attempts(spark, d):
    return derived.frame(spark, d, derived.ATTEMPTS)


@query("provider_health_final", _health + " SELECT provider_id, CASE WHEN arg_max(n, seq) >= 3 THEN 'unhealthy' WHEN arg_max(n, seq) > 0 THEN 'degraded' ELSE 'healthy' END AS status, arg_max(n, seq) AS consecutive_failures, max(CASE WHEN ok THEN seq END) AS last_success, max(CASE WHEN NOT ok THEN seq END) AS last_failure FROM streak GROUP BY provider_id")
def _(spark, d):
    return providers.final_health(_attempts(spark, d))


@query("provider_replay", _health + ", dead AS (SELECT provider_id, min(CASE WHEN n >= 3 THEN seq END) AS died FROM streak GROUP BY provider_id) SELECT provider_id, count(*) AS attempts, count(CASE WHEN died IS NULL OR seq <= died THEN 1 END) AS ran FROM streak JOIN dead USING (provider_id) GROUP BY provider_id")
def _(spark, d):
    return providers.replay(_attempts(spark, d)).groupBy("provider_id").agg(F.count("*").alias("attempts"), F.count_if("ran").alias("ran"))


_plan = """SELECT event_id AS subject_id, CAST(p AS int) AS place, 'p' || CAST(p AS string) AS provider_id, (event_id + p) % 7 <> 0 AS enabled, CASE WHEN (event_id * p) % 5 = 1 THEN 'unhealthy' ELSE 'healthy' END AS health,
 CASE WHEN (event_id + p) % 3 = 0 THEN ts END AS last_run, CAST(p * 10 AS int) AS max_age_days, p = 3 AS fallback_only, CAST((event_id + p) % 3 AS bigint) AS results, (event_id + p) % 4 <> 0 AS ok, ts
 FROM {events} CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 UNION ALL SELECT 3) x"""
_skip = f"WITH plan AS ({derived.plain(_plan)}), base AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN health = 'unhealthy' THEN 'unhealthy' WHEN last_run IS NOT NULL AND TIMESTAMP '2024-02-01 00:00:00' < last_run + to_days(max_age_days) THEN 'not_stale' END AS s0 FROM plan), skips AS MATERIALIZED (SELECT *, coalesce(s0, CASE WHEN fallback_only AND coalesce(sum(CASE WHEN s0 IS NULL THEN results ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'fallback_not_needed' END) AS skip FROM base)"


def _skips(spark, d):
    return providers.skips(derived.frame(spark, d, _plan), F.expr("TIMESTAMP '2024-02-01 00:00:00'"))


@query("provider_skips", _skip + " SELECT subject_id, provider_id, skip FROM skips")
def _(spark, d):
    return _skips(spark, d).select("subject_id", "provider_id", "skip")


@query("provider_metrics", _skip + " SELECT subject_id, count(*) AS considered, count(CASE WHEN skip IS NULL THEN 1 END) AS executed, count(CASE WHEN skip IS NULL AND ok THEN 1 END) AS succeeded, count(CASE WHEN skip IS NULL AND NOT ok THEN 1 END) AS failed, count(skip) AS skipped, CAST(coalesce(sum(CASE WHEN skip IS NULL THEN results END), 0) AS bigint) AS collected FROM skips GROUP BY subject_id")
def _(spark, d):
    return providers.coordination_metrics(_skips(spark, d))


@query("provider_staleness", f"WITH plan AS ({derived.plain(_plan)}) SELECT subject_id, provider_id, last_run IS NULL OR TIMESTAMP '2024-02-01 00:00:00' >= last_run + to_days(max_age_days) AS stale FROM plan")
def _(spark, d):
    return derived.frame(spark, d, _plan).select("subject_id", "provider_id", providers.stale(F.expr("TIMESTAMP '2024-02-01 00:00:00'"), F.col("last_run"), F.col("max_age_days")).alias("stale"))


def _template(k, t):
    filled, needs = "'" + t + "'", []
    for p in ("name", "company", "title"):
        if "{" + p + "}" in t:
            filled, needs = f"replace({filled}, '{{{p}}}', {p})", [*needs, f"{p} <> ''"]
    return f"SELECT subject_id, {k} AS position, {filled} AS query FROM subject WHERE {' AND '.join(needs)}"


_subject = ", subject AS (SELECT subject_id, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS name, coalesce(company_name, '') AS company, coalesce(title, '') AS title FROM people)"


@query("query_templates", WITH + _subject + " SELECT provider, subject_id, query, min(position) AS position FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS provider, x.* FROM ({_template(k, t)}) x" for p, ts in R.QUERY_TEMPLATES.items() for k, t in enumerate(ts)) + ") GROUP BY provider, subject_id, query")
def _(spark, d):
    s = people(spark, d).select("subject_id", F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))).alias("name"), F.col("company_name").alias("company"), "title")
    return reduce(DataFrame.unionByName, [providers.queries(s, p).withColumn("provider", F.lit(p)) for p in R.QUERY_TEMPLATES])


_sent = "CASE WHEN provider = 'news_search' THEN '(site:reuters.com OR site:bloomberg.com OR site:finance.yahoo.com OR site:businesswire.com OR site:prnewswire.com OR site:globenewswire.com) ' || query ELSE query END"


@query("query_requests", f"SELECT provider, site, sent, cache_key, count(*) AS subjects FROM (SELECT provider, {_sent} AS sent, CASE WHEN provider = 'linkedin_search' THEN 'linkedin.com' END AS site, CASE WHEN provider = 'linkedin_search' THEN 'linkedin.com::' ELSE '::' END || {_sent} AS cache_key FROM ({SQL['query_templates']})) GROUP BY ALL")
def _(spark, d):
    s = people(spark, d).select("subject_id", F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))).alias("name"), F.col("company_name").alias("company"), "title")
    return providers.request_counts(s)


_bodies = "SELECT event_id AS subject_id, 'user' || CAST(user_id AS string) || '@x.com' AS email, CAST(CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 408 ELSE 200 END AS int) AS http_status, CASE event_id % 7 WHEN 0 THEN 'throttle_triggered' WHEN 1 THEN 'temp_unavail' ELSE 'success' END AS s, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'disposable' WHEN 3 THEN 'catchall' ELSE 'unknown' END AS r FROM {events}"


@query("email_verification", f"WITH b AS ({derived.plain(_bodies)}) SELECT subject_id, CASE WHEN http_status = 429 THEN 'rate_limited' WHEN http_status = 408 THEN 'timeout' WHEN http_status >= 400 THEN 'error' WHEN s = 'success' THEN CASE r WHEN 'valid' THEN 'valid' WHEN 'invalid' THEN 'invalid' WHEN 'unknown' THEN 'unknown' ELSE 'risky' END WHEN s = 'throttle_triggered' THEN 'rate_limited' ELSE 'error' END AS status, (http_status >= 500 OR http_status = 429 OR s <> 'success') AS retryable, 'u***@x.com' AS masked FROM b")
def _(spark, d):
    b = derived.frame(spark, d, _bodies).withColumn("body", F.to_json(F.struct(F.col("s").alias("status"), F.col("r").alias("result"))))
    return providers.verification(b).select("subject_id", "status", "retryable", "masked")


# ---- simulation ----------------------------------------------------------------------------------------------------

_pick, _upto = "CASE", 0
for _name, _w in R.SCENARIOS:
    _upto += _w
    _pick += f" WHEN b < {_upto} THEN '{_name}'"


@query("sim_scenarios", WITH + f" SELECT subject_id, {_pick} END AS scenario FROM (SELECT subject_id, CAST('0x' || substr(sha256(subject_id), 1, 8) AS bigint) % 100 AS b FROM people)")
def _(spark, d):
    return people(spark, d).select("subject_id", simulation.scenario(F.col("subject_id")).alias("scenario"))


@query("sim_observations")
def _(spark, d):
    return simulation.observations(people(spark, d), "subject_id")
