"""Named queries over the cleaning rules, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.operators import cleaning
from dossier.operators.cleaning import Profile
from dossier.operators.rules import BUSINESS, RULES, SAFE, WARNING, Draft, Rule
from dossier.plans import derived

QUERIES, SQL = {}, {}


def contacts(spark, sf_dir):
    return derived.frame(spark, sf_dir, derived.CONTACTS)


# ---- the oracle's vocabulary ----------------------------------------------------------------------------


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x):
    return strip(f"regexp_replace({x}, '[ \\t]+', ' ', 'g')")


def cap(x):
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def quoted(values):
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def case(x, table, other="NULL"):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def words(x, change, pattern="(\\s+|\\S+)"):
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{pattern}'), lambda t: {change}), '')"


def name_case(x):
    token = f"CASE WHEN t = '' THEN t WHEN lower(t) IN ({quoted(R.PARTICLES)}) THEN lower(t)"
    for p in R.NAME_PREFIXES:
        q = p.replace("'", "''")
        token += f" WHEN starts_with(lower(t), '{q}') AND length(t) > {len(p)} THEN '{q.capitalize()}' || {cap(f'substr(lower(t), {len(p) + 1})')}"
    token += f" ELSE {cap('t')} END"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda t: {token}), '-')), ' ')"


def acronyms(x):
    return words(x, f"CASE WHEN lower(t) IN ({quoted(R.ACRONYMS)}) THEN upper(t) ELSE t END", "(\\s+|[,/-]|[^\\s,/-]+)")


def present(x):
    return f"coalesce({strip(x)} <> '', false)"


def iso(x):
    s = strip(x)
    return f"CASE WHEN length({s}) = 2 AND upper({s}) IN ({quoted(R.COUNTRY_NAMES)}) THEN upper({s}) ELSE {case(f'lower({s})', R.COUNTRY_CODES)} END"


_MAIL = "regexp_replace({x}, '\\s+', '', 'g')"
_PHONE = norm("regexp_replace({x}, '^''+', '')")
_BOOL = lambda x: case(f"lower({strip(x)})", R.BOOLEANS, x)
#: The contacts after the default profile.
CLEAN = f"""WITH contacts AS MATERIALIZED ({derived.plain(derived.CONTACTS)}), z AS MATERIALIZED (SELECT k, segment,
 {name_case(norm("first_name"))} AS first_name, {name_case(norm("last_name"))} AS last_name, {acronyms(norm("title"))} AS title, {norm("contact_level")} AS contact_level,
 lower({_MAIL.format(x="email")}) AS email0, {_MAIL.format(x="email")} AS mail, lower({_MAIL.format(x="company_email")}) AS company_email,
 {_PHONE.format(x="direct_phone")} AS direct_phone, {_PHONE.format(x="phone")} AS phone, {norm("company_name")} AS company_name, {norm("parent_company")} AS parent_company,
 ticker, {norm("ownership_type")} AS ownership_type, {norm("business_description")} AS business_description, {strip("duns_number")} AS duns_number,
 {_BOOL("is_headquarters")} AS is_headquarters, {_BOOL("tps_flag")} AS tps_flag,
 CASE WHEN {norm("address_line_1")} <> '' THEN {norm("address_line_1")} END AS address_line_1, {norm("city")} AS city, {norm("state_or_province")} AS state_or_province,
 {norm("postal_code")} AS postal_code, {norm("country")} AS country, sales_usd, assets_usd, employees_single_site, employees_total,
 {norm("industry_label")} AS industry_label, {strip("naics_code")} AS naics_code, {norm("naics_description")} AS naics_description, {norm("url")} AS url, {norm("source")} AS source, dedup_id
 FROM contacts), c AS MATERIALIZED (SELECT z.*, CASE WHEN contains(mail, '@') THEN email0 ELSE mail END AS email FROM z)
"""


def add(name, fields, sql, **profile):
    """A query of cleaned fields: k and each field, against one SELECT over contacts."""

    def run(spark, sf_dir):
        return cleaning.clean(contacts(spark, sf_dir), Profile(**profile)).select("k", *fields)

    QUERIES[name], SQL[name] = run, f"WITH contacts AS ({derived.plain(derived.CONTACTS)}) SELECT k, {sql} FROM contacts"


def fields_sql(change, *fields):
    return ", ".join(f"{change(f)} AS {f}" for f in fields)


_text = ("first_name", "last_name", "title", "company_name", "address_line_1", "city", "industry_label", "url")
add("clean_whitespace", (*_text, "duns_number", "naics_code"), fields_sql(norm, *_text) + ", " + fields_sql(strip, "duns_number", "naics_code"), only=("CLN-001", "CLN-024", "CLN-025", "CLN-035", "CLN-051", "CLN-052", "CLN-056", "CLN-059"))
_marked = "title || ' Cafe' || chr(769)"
QUERIES["clean_whitespace_unicode"] = lambda spark, sf_dir: cleaning.clean(contacts(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" Cafe\u0301"))), Profile(only=("CLN-001",))).select("k", "title")
SQL["clean_whitespace_unicode"] = f"WITH contacts AS ({derived.plain(derived.CONTACTS)}) SELECT k, {norm(f'nfc_normalize({_marked})')} AS title FROM contacts"
_low = lambda x: f"CASE WHEN contains({x}, '@') THEN lower({_MAIL.format(x=x)}) ELSE {_MAIL.format(x=x)} END"
add("clean_email_case", ("email", "company_email"), fields_sql(_low, "email", "company_email"), only=("CLN-011", "CLN-013", "CLN-014"))
add("clean_phone_artifact", ("direct_phone", "phone"), fields_sql(lambda x: _PHONE.format(x=x), "direct_phone", "phone"), only=("CLN-012",))
add("clean_missing_repr", ("address_line_1",), f"CASE WHEN {strip('address_line_1')} <> '' THEN address_line_1 END AS address_line_1", only=("CLN-036", "CLN-044"))
add("clean_boolean", ("is_headquarters", "tps_flag"), fields_sql(_BOOL, "is_headquarters", "tps_flag"), only=("CLN-028", "CLN-058"))
_first = lambda a, b: f"CASE WHEN {present(a)} THEN {a} WHEN {present(b)} THEN {b} END"
add("clean_primary_select", ("primary_email", "primary_phone"), f"{_first('email', 'company_email')} AS primary_email, {_first('direct_phone', 'phone')} AS primary_phone", only=("CLN-015", "CLN-017"))
add("clean_name_casing", ("first_name", "last_name"), fields_sql(lambda x: name_case(norm(x)), "first_name", "last_name"), only=("CLN-001", "CLN-002"))
add("clean_title_acronyms", ("title",), fields_sql(lambda x: acronyms(norm(x)), "title"), only=("CLN-001", "CLN-004"))
add("clean_title_expand", ("title",), fields_sql(lambda x: words(norm(x), case("lower(t)", R.TITLE_EXPANSIONS, "t")), "title"), only=("CLN-001", "CLN-005"))
_suffix = "\\s+((?i)Jr\\.?|Sr\\.?|I{1,3}|IV|V|Ph\\.?D\\.?|M\\.?D\\.?)$"
add("clean_name_suffix", ("last_name", "name_suffix"), f"CASE WHEN regexp_matches(last_name, '(?i){R.NAME_SUFFIX}') THEN {strip(f'''regexp_replace(last_name, '(?i){R.NAME_SUFFIX}', '')''')} ELSE last_name END AS last_name, nullif(regexp_extract(last_name, '(?i){R.NAME_SUFFIX}', 1), '') AS name_suffix", only=("CLN-003",), parameters={"CLN-003": {"strip": True}})
_last = f"string_split({strip(norm('company_name'))}, ' ')[-1]"
_key = f"regexp_replace(lower({_last}), '[.,]+$', '')"
_head = f"regexp_replace(substr({norm('company_name')}, 1, length({norm('company_name')}) - length({_last})), '[ ,]+$', '')"
add("clean_legal_suffix", ("company_name_normalized",), f"CASE WHEN {case(_key, R.LEGAL_SUFFIXES)} IS NOT NULL THEN {_head} || ' ' || {case(_key, R.LEGAL_SUFFIXES)} END AS company_name_normalized", only=("CLN-024", "CLN-026"))
_bare = "regexp_replace(t, '[.,]+$', '')"
_company = f"CASE WHEN regexp_full_match(t, '\\s*') THEN t WHEN {case(f'lower({_bare})', R.BRANDS)} IS NOT NULL THEN {case(f'lower({_bare})', R.BRANDS)} || substr(t, length({_bare}) + 1) ELSE {cap('t')} END"
add("clean_company_casing", ("company_name",), words("company_name", _company) + " AS company_name", only=("CLN-027",))
_state, _country = f"upper({strip('state_or_province')})", f"lower({strip('country')})"
add("clean_state_country", ("state_or_province", "country"), f"{case(f'lower({strip('state_or_province')})', R.STATE_CODES, 'state_or_province')} AS state_or_province, {case(_country, R.COUNTRY_CODES, 'country')} AS country", only=("CLN-037", "CLN-038"), parameters={"CLN-037": {"target": "code"}, "CLN-038": {"target": "code"}})
add("clean_state_names", ("state_or_province", "country"), f"{case(_state, R.STATE_NAMES, 'state_or_province')} AS state_or_province, {case(f'upper({strip('country')})', R.COUNTRY_NAMES, 'country')} AS country", only=("CLN-037", "CLN-038"), parameters={"CLN-037": {"target": "name"}, "CLN-038": {"target": "name"}})
add("clean_postal", ("postal_code",), "CASE WHEN regexp_full_match(trim(postal_code), '\\d{5}-\\d{4}') THEN substr(trim(postal_code), 1, 5) ELSE postal_code END AS postal_code", only=("CLN-039",), parameters={"CLN-039": {"target": "5_digit"}})
add("clean_street", ("address_line_1",), f"CASE WHEN {iso('country')} = 'US' THEN {words('address_line_1', case('''regexp_replace(lower(t), '[.,]+$', '')''', R.STREET_SUFFIXES, 't'))} ELSE address_line_1 END AS address_line_1", only=("CLN-040",))


def _e164(x):
    d, region = f"regexp_replace({x}, '\\D', '', 'g')", f"coalesce({iso('country')}, 'US')"
    code = f"CASE {region} WHEN 'US' THEN '1' WHEN 'CA' THEN '1' END"
    return f"CASE WHEN {d} = '' THEN {x} WHEN starts_with(trim({x}), '+') OR coalesce(starts_with({d}, {code}) AND length({d}) = 11, false) THEN '+' || {d} ELSE '+' || coalesce({code}, '') || {d} END"


add("clean_e164", ("direct_phone", "phone"), fields_sql(_e164, "direct_phone", "phone"), only=("CLN-067",), parameters={"CLN-067": {"default_region": "US"}})
_money = Profile(only=("CLN-045", "CLN-046", "CLN-047"), parameters={"CLN-045": {"currency": "USD"}, "CLN-046": {"scale": "thousands"}, "CLN-047": {"round_to_nearest": 500}})
add("clean_currency_scale_round", ("sales_usd", "sales_usd_currency", "sales_usd_rounded", "assets_usd", "assets_usd_rounded"), "sales_usd * 1000 AS sales_usd, CASE WHEN sales_usd IS NOT NULL THEN 'USD' END AS sales_usd_currency, round_even(sales_usd * 1000 / 500, 0) * 500 AS sales_usd_rounded, assets_usd * 1000 AS assets_usd, round_even(assets_usd * 1000 / 500, 0) * 500 AS assets_usd_rounded", only=_money.only, parameters=_money.parameters)
add("clean_url_scheme", ("url",), f"CASE WHEN NOT regexp_matches({strip('url')}, '{R.URL_SCHEME}') AND regexp_matches({strip('url')}, '{R.BARE_DOMAIN}') THEN 'https://' || {strip('url')} ELSE url END AS url", only=("CLN-057",))

# ---- warnings ---------------------------------------------------------------------------------------------

_p = present
_same = lambda a, b: f"lower({strip(a)}) <> '' AND lower({strip(a)}) = lower({strip(b)})"
_digits = lambda x: f"length(regexp_replace({x}, '\\D', '', 'g'))"
_domain = "regexp_replace(lower(string_split(regexp_replace(" + strip("url") + ", '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/')[1]), '^www\\.', '')"
_level = "CASE " + " ".join(f"WHEN contains(lower(contact_level), '{key}') THEN {' OR '.join(f'''contains(lower(title), '{w}')''' for w in ws)}" for key, ws in R.LEVEL_KEYWORDS.items()) + " ELSE true END"
CONDITIONS = {
    "CLN-006": [("MISSING_FIRST_NAME", f"NOT {_p('first_name')}"), ("MISSING_LAST_NAME", f"NOT {_p('last_name')}")],
    "CLN-007": [("IDENTICAL_FIRST_LAST_NAME", _same("first_name", "last_name"))],
    "CLN-008": [("UNEXPECTED_CHARACTERS_IN_NAME", f"{f} <> '' AND regexp_matches({f}, '[^A-Za-z\\s\\-''À-ɏ]')") for f in ("first_name", "last_name")],
    "CLN-009": [("TITLE_UNUSUALLY_LONG", "length(title) > 100")],
    "CLN-010": [("CONTACT_LEVEL_TITLE_MISMATCH", f"contact_level <> '' AND title IS NOT NULL AND NOT ({_level})")],
    "CLN-018": [("MISSING_EMAIL", f"NOT {_p('email')}")],
    "CLN-019": [("MALFORMED_EMAIL_SHAPE", f"{f} <> '' AND (length({f}) - length(replace({f}, '@', '')) <> 1 OR (contains({f}, '@') AND NOT contains(string_split({f}, '@')[-1], '.')))") for f in ("email", "company_email")],
    "CLN-020": [("ROLE_BASED_EMAIL_PATTERN", f"contains(email, '@') AND lower(regexp_extract(email, '^(.*)@[^@]*$', 1)) IN ({quoted(R.ROLE_INBOXES)})")],
    "CLN-021": [("MISSING_PHONE", f"NOT ({_p('direct_phone')} OR {_p('phone')})")],
    "CLN-022": [("IMPLAUSIBLE_PHONE_DIGIT_COUNT", f"{f} <> '' AND {_digits(f)} < 7") for f in ("direct_phone", "phone")],
    "CLN-023": [("PHONE_CONTAINS_LETTERS", f"{f} <> '' AND regexp_matches({f}, '[A-Za-z]')") for f in ("direct_phone", "phone")],
    "CLN-029": [("MISSING_COMPANY_NAME", f"NOT {_p('company_name')}")],
    "CLN-030": [("COMPANY_EQUALS_PARENT", _same("company_name", "parent_company"))],
    "CLN-031": [("TICKER_WITHOUT_PUBLIC_OWNERSHIP", f"{strip('ticker')} <> '' AND NOT coalesce(list_contains(list_transform(string_split(ownership_type, ','), lambda x: lower(trim(x))), 'public'), false)")],
    "CLN-032": [("BUSINESS_DESCRIPTION_SUSPICIOUSLY_SHORT", "business_description <> '' AND length(business_description) < 10")],
    "CLN-033": [("DUNS_SHAPE_UNEXPECTED", "duns_number <> '' AND NOT regexp_full_match(duns_number, '\\d{9}')")],
    "CLN-034": [("MISSING_KEY_ID", "true")],
    "CLN-041": [("INCOMPLETE_ADDRESS_COMPONENTS", f"CAST({_p('city')} AS int) + CAST({_p('state_or_province')} AS int) + CAST({_p('postal_code')} AS int) BETWEEN 1 AND 2")],
    "CLN-042": [("POSTAL_CODE_SHAPE_UNEXPECTED", f"postal_code <> '' AND {iso('country')} = 'US' AND NOT regexp_full_match(trim(postal_code), '\\d{{5}}(-\\d{{4}})?')")],
    "CLN-043": [("ADDRESS_LINE_DUPLICATES_CITY", _same("address_line_1", "city"))],
    "CLN-048": [("IMPLAUSIBLE_NEGATIVE_VALUE", f"{f} < 0") for f in ("sales_usd", "assets_usd", "employees_total")],
    "CLN-049": [("SINGLE_SITE_EXCEEDS_TOTAL_EMPLOYEES", "employees_single_site > employees_total")],
    "CLN-050": [("FINANCIAL_DATA_WITHOUT_SALES", "assets_usd IS NOT NULL AND sales_usd IS NULL")],
    "CLN-053": [("CODE_DESCRIPTION_PAIR_INCOMPLETE", f"{_p('naics_code')} <> {_p('naics_description')}")],
    "CLN-054": [("UNRECOGNIZED_CLASSIFICATION_CODE", f"{strip('naics_code')} <> '' AND {strip('naics_code')} NOT IN ({quoted(R.KNOWN_CODES['naics_code'])})")],
    "CLN-055": [("INDUSTRY_LABEL_MISSING", f"{_p('naics_code')} AND NOT {_p('industry_label')}")],
    "CLN-060": [("MISSING_SOURCE", f"NOT {_p('source')}")],
    "CLN-061": [("MALFORMED_URL_SHAPE", f"{strip('url')} <> '' AND NOT regexp_matches({strip('url')}, '{R.URL_SCHEME}') AND NOT regexp_matches({strip('url')}, '{R.BARE_DOMAIN}')")],
    "CLN-062": [("DEDUP_ID_NOT_RELIABLE", _p("dedup_id"))],
    "CLN-063": [("NO_CONTACT_METHOD_AVAILABLE", f"NOT ({_p('email')} OR {_p('direct_phone')} OR {_p('phone')})")],
    "CLN-064": [("NAME_DUPLICATES_COMPANY_NAME", _same("(first_name || ' ' || last_name)", "company_name"))],
    "CLN-065": [("ADDRESS_DUPLICATES_COMPANY_NAME", _same("address_line_1", "company_name"))],
    "CLN-066": [("EMAIL_DOMAIN_COMPANY_DOMAIN_MISMATCH", f"contains(email, '@') AND string_split(email, '@')[-1] <> '' AND lower(string_split(email, '@')[-1]) NOT IN ({quoted(R.GENERIC_DOMAINS)}) AND {strip('url')} <> '' AND {_domain} <> '' AND lower(string_split(email, '@')[-1]) <> {_domain}")],
    "CLN-068": [("FINANCIAL_DATA_WITHOUT_INDUSTRY_CLASSIFICATION", f"sales_usd IS NOT NULL AND NOT ({_p('industry_label')} OR {_p('naics_code')})")],
}


def warned(spark, sf_dir, rules):
    """The warnings of some rules, after all normalizations of the default profile."""
    others = {r.id: False for r in RULES if r.stage == WARNING and r.id not in rules}
    out = cleaning.clean(contacts(spark, sf_dir), Profile(enabled_rules=others)).select("k", F.explode_outer("warnings").alias("w"))
    return out.where("w is not null").select("k", "w.rule_id", "w.code")


def warned_sql(rules):
    return " UNION ALL ".join(f"SELECT k, '{r}' AS rule_id, '{code}' AS code FROM c WHERE {when}" for r in rules for code, when in CONDITIONS[r])


for _name, _rules in {
    "warn_missing": ("CLN-006", "CLN-018", "CLN-021", "CLN-029", "CLN-034", "CLN-060", "CLN-063"),
    "warn_identical": ("CLN-007", "CLN-030", "CLN-043", "CLN-064", "CLN-065"),
    "warn_shape": ("CLN-008", "CLN-019", "CLN-020", "CLN-023", "CLN-033", "CLN-042", "CLN-061"),
    "warn_threshold": ("CLN-009", "CLN-032"),
    "warn_digits": ("CLN-022",),
    "warn_negative": ("CLN-048", "CLN-049"),
    "warn_presence": ("CLN-010", "CLN-031", "CLN-041", "CLN-050", "CLN-055", "CLN-062", "CLN-068"),
    "warn_pairs": ("CLN-053",),
    "warn_reference": ("CLN-054",),
    "warn_domain_mismatch": ("CLN-066",),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, rules=_rules: warned(spark, sf_dir, rules)
    SQL[_name] = CLEAN + warned_sql(_rules)

# ---- audit, metrics, report -------------------------------------------------------------------------------------

_few = Profile(only=("CLN-012", "CLN-025", "CLN-028", "CLN-032", "CLN-058"))
_pairs = {"CLN-012": [(f, _PHONE.format(x=f)) for f in ("direct_phone", "phone")], "CLN-025": [("duns_number", strip("duns_number"))], "CLN-028": [("is_headquarters", _BOOL("is_headquarters"))], "CLN-058": [("tps_flag", _BOOL("tps_flag"))]}
_changes = " UNION ALL ".join(f"SELECT k, 'change' AS kind, '{r}' AS rule_id, '{f}' AS field_name, {f} AS old_value, {new} AS new_value, NULL AS code FROM contacts WHERE {f} IS DISTINCT FROM {new}" for r, fs in _pairs.items() for f, new in fs)
_warnings = "SELECT k, 'warning' AS kind, 'CLN-032' AS rule_id, 'business_description' AS field_name, NULL AS old_value, NULL AS new_value, 'BUSINESS_DESCRIPTION_SUSPICIOUSLY_SHORT' AS code FROM contacts WHERE business_description <> '' AND length(business_description) < 10"
_with = f"WITH contacts AS ({derived.plain(derived.CONTACTS)}), audit AS ({_changes} UNION ALL {_warnings}) "
QUERIES["clean_audit_trail"] = lambda spark, sf_dir: cleaning.audit_trail(cleaning.clean(contacts(spark, sf_dir), _few), "k").drop("position", "at")
SQL["clean_audit_trail"] = _with + "SELECT *, 1 AS rule_version FROM audit"


def metrics_sql(enabled, failures="CAST(0 AS bigint)", affected="(SELECT count(DISTINCT k) FROM audit a WHERE a.rule_id = r.rule_id)"):
    """All 68 rules; those that are off are skipped for every record."""
    on = f"r.rule_id IN ({quoted(enabled)})"
    return f"""SELECT rule_id, 1 AS rule_version, CASE WHEN {on} THEN (SELECT count(*) FROM contacts) ELSE 0 END AS records_evaluated, CASE WHEN {on} THEN 0 ELSE (SELECT count(*) FROM contacts) END AS records_skipped,
 {affected} AS records_affected, (SELECT count(*) FROM audit a WHERE kind = 'change' AND a.rule_id = r.rule_id) AS changes, (SELECT count(*) FROM audit a WHERE kind = 'warning' AND a.rule_id = r.rule_id) AS warnings, {failures} AS failures
 FROM (SELECT printf('CLN-%03d', i) AS rule_id FROM range(1, 69) t(i)) r"""


QUERIES["clean_rule_metrics"] = lambda spark, sf_dir: cleaning.rule_metrics(cleaning.clean(contacts(spark, sf_dir), _few), _few).drop("stage", "category")
SQL["clean_rule_metrics"] = _with + metrics_sql(_few.only)
QUERIES["clean_run_report"] = lambda spark, sf_dir: cleaning.run_report(cleaning.clean(contacts(spark, sf_dir), _few))
SQL["clean_run_report"] = _with + "SELECT (SELECT count(*) FROM contacts) AS records, count(DISTINCT CASE WHEN kind = 'change' THEN k END) AS records_with_changes, count(DISTINCT CASE WHEN kind = 'warning' THEN k END) AS records_with_warnings, CAST(0 AS bigint) AS records_with_failures, count(CASE WHEN kind = 'change' THEN 1 END) AS changes, count(CASE WHEN kind = 'warning' THEN 1 END) AS warnings, CAST(0 AS bigint) AS failures FROM audit"

# ---- the same of a whole run: all rules of the default profile --------------------------------------------------

_mail = lambda x: _MAIL.format(x=x)
_at = lambda x: f"CASE WHEN contains({x}, '@') THEN regexp_extract({x}, '^(.*)@[^@]*$', 1) || '@' || lower(string_split({x}, '@')[-1]) ELSE {x} END"
_names, _emails, _phones, _address = ("first_name", "last_name"), ("email", "company_email"), ("direct_phone", "phone"), ("address_line_1", "city", "state_or_province", "postal_code", "country")
#: Rule, field, value before and after it; each sees what the rules before it made.
_STEPS = [
    *[("CLN-001", f, f, norm(f)) for f in (*_names, "title", "contact_level")],
    *[("CLN-011", f, f, _mail(f)) for f in _emails],
    *[("CLN-012", f, f, _PHONE.format(x=f)) for f in _phones],
    *[("CLN-013", f, _mail(f), _at(_mail(f))) for f in _emails],
    *[("CLN-024", f, f, norm(f)) for f in ("company_name", "ownership_type", "parent_company", "business_description")],
    ("CLN-025", "duns_number", "duns_number", strip("duns_number")),
    *[("CLN-035", f, f, norm(f)) for f in _address],
    ("CLN-036", "address_line_1", norm("address_line_1"), f"nullif({norm('address_line_1')}, '')"),
    *[("CLN-051", f, f, norm(f)) for f in ("industry_label", "naics_description")],
    ("CLN-052", "naics_code", "naics_code", strip("naics_code")),
    *[("CLN-056", f, f, norm(f)) for f in ("source", "url")],
    *[("CLN-002", f, norm(f), name_case(norm(f))) for f in _names],
    ("CLN-004", "title", norm("title"), acronyms(norm("title"))),
    *[("CLN-014", f, _at(_mail(f)), _low(f)) for f in _emails],
    ("CLN-028", "is_headquarters", "is_headquarters", _BOOL("is_headquarters")),
    ("CLN-058", "tps_flag", "tps_flag", _BOOL("tps_flag")),
]
#: Derived from cleaned fields.
_DERIVED = [("CLN-015", "primary_email", _first("email", "company_email")), ("CLN-017", "primary_phone", _first("direct_phone", "phone"))]
_codes = ",".join(a for a, _ in R.CODE_PAIRS)
#: Fields of each condition's warning, in the order of CONDITIONS.
_NOTED = {
    "CLN-006": _names, "CLN-007": ("first_name,last_name",), "CLN-008": _names, "CLN-009": ("title",), "CLN-010": ("contact_level,title",), "CLN-018": ("email",), "CLN-019": _emails, "CLN-020": ("email",),
    "CLN-021": ("direct_phone,phone",), "CLN-022": _phones, "CLN-023": _phones, "CLN-029": ("company_name",), "CLN-030": ("company_name,parent_company",), "CLN-031": ("ticker,ownership_type",),
    "CLN-032": ("business_description",), "CLN-033": ("duns_number",), "CLN-034": ("key_id",), "CLN-041": ("city,state_or_province,postal_code",), "CLN-042": ("postal_code,country",), "CLN-043": ("address_line_1,city",),
    "CLN-048": ("sales_usd", "assets_usd", "employees_total"), "CLN-049": ("employees_single_site,employees_total",), "CLN-050": ("assets_usd,pre_tax_profit_usd,liabilities_usd,sales_usd",), "CLN-053": ("naics_code,naics_description",),
    "CLN-054": ("naics_code",), "CLN-055": (f"{_codes},industry_label",), "CLN-060": ("source",), "CLN-061": ("url",), "CLN-062": ("dedup_id",), "CLN-063": ("email,direct_phone,phone",),
    "CLN-064": ("first_name,last_name,company_name",), "CLN-065": ("address_line_1,company_name",), "CLN-066": ("email,url",), "CLN-068": (f"sales_usd,industry_label,{_codes}",),
}
_row = "SELECT k, '{kind}' AS kind, '{rule}' AS rule_id, '{field}' AS field_name, {old} AS old_value, {new} AS new_value, {code} AS code FROM {table} WHERE {when}"
_all = " UNION ALL ".join([
    *[_row.format(kind="change", rule=r, field=f, old=old, new=new, code="CAST(NULL AS varchar)", table="contacts", when=f"({old}) IS DISTINCT FROM ({new})") for r, f, old, new in _STEPS],
    *[_row.format(kind="change", rule=r, field=f, old="NULL", new=new, code="NULL", table="c", when=f"({new}) IS NOT NULL") for r, f, new in _DERIVED],
    *[_row.format(kind="warning", rule=r, field=f, old="NULL", new="NULL", code=f"'{code}'", table="c", when=when) for r, fs in _NOTED.items() for f, (code, when) in zip(fs, CONDITIONS[r], strict=True)],
])
#: Rules without a field among the contacts (CLN-044 looks at text only) still run.
_RULES = sorted({r for r, *_ in (*_STEPS, *_DERIVED)} | set(CONDITIONS) | {"CLN-044", "CLN-059"})
_acronym = f"len(list_filter(regexp_extract_all({norm('title')}, '(\\s+|[,/-]|[^\\s,/-]+)'), lambda t: lower(t) IN ({quoted(R.ACRONYMS)}))) > 0"
_run = CLEAN + f", audit AS MATERIALIZED ({_all}), affected AS (SELECT rule_id, k FROM audit UNION SELECT 'CLN-004', k FROM contacts WHERE {_acronym}) "
QUERIES["clean_audit_trail_all"] = lambda spark, sf_dir: cleaning.audit_trail(cleaning.clean(contacts(spark, sf_dir)), "k").drop("position", "at")
SQL["clean_audit_trail_all"] = _run + "SELECT *, 1 AS rule_version FROM audit"
QUERIES["clean_rule_metrics_all"] = lambda spark, sf_dir: cleaning.rule_metrics(cleaning.clean(contacts(spark, sf_dir))).drop("stage", "category")
SQL["clean_rule_metrics_all"] = _run + metrics_sql(_RULES, affected="(SELECT count(*) FROM affected a WHERE a.rule_id = r.rule_id)")
QUERIES["clean_run_report_all"] = lambda spark, sf_dir: cleaning.run_report(cleaning.clean(contacts(spark, sf_dir)))
SQL["clean_run_report_all"] = _run + SQL["clean_run_report"].removeprefix(_with)

# ---- rules that raise for some records ----------------------------------------------------------------------------

#: A caller's own rules, of which each raises for some contacts: an ANSI cast, raise_error, a check that reads what the
#: first one writes.  The rules around them must not notice.
_own = (
    Rule("OWN-1", "Company number as a number", "company", SAFE, ("duns_number",), lambda r, p: {"duns_number": r.any("duns_number").cast("bigint").cast("string")}, True, ("duns_number",), version=2),
    Rule("OWN-2", "No contractors", "identity", BUSINESS, ("title",), lambda r, p: {"title": F.when(F.lower(r.any("title")) == "contractor", F.raise_error(F.lit("contractors are not ours"))).otherwise(F.upper(r.any("title")))}, True, ("title",), version=3),
    Rule("OWN-3", "Company number below a limit", "company", WARNING, ("duns_number",), lambda r, p: [Draft(r.any("duns_number").cast("int") > 0, "NUMBERED", "The company has a number.", ("duns_number",))]),
)
_raising = Profile(rules=(*RULES, *_own))
_digits_only = f"TRY_CAST({strip('duns_number')} AS bigint)"
_own_duns = f"coalesce(CAST({_digits_only} AS varchar), {strip('duns_number')})"
_own_int = f"TRY_CAST({_own_duns} AS int)"
_after = acronyms(norm("title"))
_own_title = f"CASE WHEN lower({_after}) = 'contractor' THEN {_after} ELSE upper({_after}) END"
_failed = " UNION ALL ".join([
    f"SELECT k, 'OWN-1' AS rule_id, 2 AS rule_version, 'safe' AS stage FROM contacts WHERE duns_number IS NOT NULL AND {_digits_only} IS NULL",
    f"SELECT k, 'OWN-2', 3, 'business' FROM contacts WHERE lower({_after}) = 'contractor'",
    f"SELECT k, 'OWN-3', 1, 'warning' FROM contacts WHERE duns_number IS NOT NULL AND {_own_int} IS NULL",
])
QUERIES["clean_guarded_failures"] = lambda spark, sf_dir: cleaning.failure_rows(cleaning.clean(contacts(spark, sf_dir), _raising), "k").select("k", "rule_id", "rule_version", "stage")
SQL["clean_guarded_failures"] = f"WITH contacts AS ({derived.plain(derived.CONTACTS)}) {_failed}"
QUERIES["clean_guarded_audit"] = lambda spark, sf_dir: cleaning.audit_trail(cleaning.clean(contacts(spark, sf_dir), _raising), "k").drop("position", "at")
_own_audit = " UNION ALL ".join([
    _row.format(kind="change", rule="OWN-1", field="duns_number", old=strip("duns_number"), new=_own_duns, code="NULL", table="contacts", when=f"{strip('duns_number')} IS DISTINCT FROM {_own_duns}"),
    _row.format(kind="change", rule="OWN-2", field="title", old=_after, new=_own_title, code="NULL", table="contacts", when=f"{_after} IS DISTINCT FROM {_own_title}"),
    _row.format(kind="warning", rule="OWN-3", field="duns_number", old="NULL", new="NULL", code="'NUMBERED'", table="contacts", when=f"{_own_int} > 0"),
])
# What the own rules write is what the checks of the default profile see.
_guarded_run = CLEAN.replace(f'{strip("duns_number")} AS duns_number', f"{_own_duns} AS duns_number").replace(f"{_after} AS title", f"{_own_title} AS title") + f", audit AS MATERIALIZED ({_all} UNION ALL {_own_audit})"
SQL["clean_guarded_audit"] = _guarded_run + " SELECT *, CASE rule_id WHEN 'OWN-1' THEN 2 WHEN 'OWN-2' THEN 3 ELSE 1 END AS rule_version FROM audit"
QUERIES["clean_guarded_report"] = lambda spark, sf_dir: cleaning.run_report(cleaning.clean(contacts(spark, sf_dir), _raising))
SQL["clean_guarded_report"] = _guarded_run + f", failed AS ({_failed}) SELECT (SELECT count(*) FROM contacts) AS records, count(DISTINCT CASE WHEN kind = 'change' THEN k END) AS records_with_changes, count(DISTINCT CASE WHEN kind = 'warning' THEN k END) AS records_with_warnings, (SELECT count(DISTINCT k) FROM failed WHERE stage <> 'warning') AS records_with_failures, count(CASE WHEN kind = 'change' THEN 1 END) AS changes, count(CASE WHEN kind = 'warning' THEN 1 END) AS warnings, (SELECT count(*) FROM failed WHERE stage <> 'warning') AS failures FROM audit"
