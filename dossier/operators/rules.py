"""The cleaning rules: 68 instances of some twenty reusable shapes.

A normalization rule maps the current columns to new ones ({field: column}); a check maps them to
drafts of warnings.  Both are plain column expressions, so a profile's rules become projections that
Catalyst plans as a whole; a disabled rule costs nothing.  Text rules act on string columns only,
numeric checks on numeric ones; a field that the table lacks is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X

SAFE, BUSINESS, WARNING = "safe", "business", "warning"


class ConfigurationError(ValueError):
    """A profile that contradicts itself; raised before any row is read."""


class Record:
    """The columns of a record as a rule sees them: by canonical name, with their types."""

    def __init__(self, columns: Mapping[str, Column], kinds: Mapping[str, str], composed: Callable[[str], str | None] = lambda name: None):
        self.columns, self.kinds, self.ready = columns, kinds, composed

    def composed(self, name: str) -> Column | None:
        """A text field in canonical composition; where nothing has changed it yet, that is there already."""
        c = self.text(name)
        if c is None:
            return None
        ready = self.ready(name)
        return X.nfc(c) if ready is None else F.col(f"`{ready}`")

    def text(self, name: str) -> Column | None:
        return self.columns[name] if self.kinds.get(name) == "string" else None

    def number(self, name: str) -> Column | None:
        return self.columns[name] if self.kinds.get(name) not in (None, "string") else None

    def any(self, name: str) -> Column:
        return self.columns.get(name, F.lit(None).cast("string"))

    def present(self, name: str) -> Column:
        return F.coalesce(X.present(self.columns[name], self.kinds[name]), F.lit(False)) if name in self.columns else F.lit(False)


@dataclass(frozen=True)
class Draft:
    when: Column
    code: str
    message: Column | str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    stage: str
    fields: tuple[str, ...]
    apply: Callable[[Record, dict], Any]
    default: bool = True
    writes: tuple[str, ...] = ()
    validate: Callable[[Any], None] | None = field(default=None, compare=False)
    #: Whether the rule counts a record as affected although nothing may have changed; none: only if something did.
    touches: Callable[[Record, dict], Column] | None = field(default=None, compare=False)
    version: int = 1
    #: Whether its expressions can raise for no record; others are evaluated under guard.
    total: bool = False


def each(change: Callable[[Column, dict], Column], *fields: str):
    """A normalization of each of some text fields by itself."""

    def apply(r: Record, params: dict) -> dict[str, Column]:
        return {f: change(c, params) for f in fields if (c := r.text(f)) is not None}

    return apply


# ---- shapes: normalizations -------------------------------------------------------------------------


def whitespace(*fields: str, artifact: str | None = None, remove_all: bool = False):
    def change(c: Column) -> Column:
        c = F.regexp_replace(c, artifact, "") if artifact else c
        return F.regexp_replace(c, r"(?U)\s+", "") if remove_all else X.normalize(c)

    def apply(r: Record, params: dict) -> dict[str, Column]:
        return {f: change(c) for f in fields if (c := r.composed(f)) is not None}

    apply.composes = fields
    return apply


def ends_only(*fields: str):
    return each(lambda c, p: X.strip(c), *fields)


def missing_values(*fields: str, sentinels: tuple[str, ...] = ("",)):
    return each(lambda c, p: F.when(~F.lower(X.strip(c)).isin(*sentinels), c), *fields)


def booleans(*fields: str):
    return each(lambda c, p: X.lookup(F.lower(X.strip(c)), R.BOOLEANS, c), *fields)


def primary(*candidates: str, to: str):
    def apply(r: Record, params: dict) -> dict[str, Column]:
        found = [F.when(r.present(f), r.any(f)) for f in candidates if f in r.columns]
        return {to: F.coalesce(*found)} if found else {}

    return apply


def standardize(name: str, to_code: dict[str, str], to_name: dict[str, str]):
    """Name to code or code to name, as `target` says; what the table lacks stays."""

    def change(c: Column, params: dict) -> Column:
        target = params.get("target")
        if target == "code":
            return X.lookup(F.lower(X.strip(c)), to_code, c)
        return X.lookup(F.upper(X.strip(c)), to_name, c) if target == "name" else c

    return each(change, name)


def email_side(domain: bool):
    def change(c: Column, params: dict) -> Column:
        local, at = F.regexp_extract(c, r"^([\s\S]*)@([^@]*)$", 1), F.regexp_extract(c, r"^([\s\S]*)@([^@]*)$", 2)
        both = F.concat(local, F.lit("@"), F.lower(at)) if domain else F.concat(F.lower(local), F.lit("@"), at)
        return F.when(c.contains("@"), both).otherwise(c)

    return each(change, "email", "company_email")


def name_case(c: Column, params: dict) -> Column:
    particles, prefixes = params.get("particles", R.PARTICLES), params.get("prefixes", R.PREFIX_HEADS)

    def one(t: Column) -> Column:
        low = F.lower(t)
        out = F.when(low.isin(*particles), low)
        for p, head in prefixes.items():
            out = out.when(low.startswith(p) & (F.length(low) > len(p)), F.concat(F.lit(head), X.capitalize(F.substring(low, F.lit(len(p) + 1), F.length(low)))))
        return out.otherwise(X.capitalize(t))

    return F.array_join(F.transform(F.split(c, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), one), "-")), " ")


def name_suffix(r: Record, params: dict) -> dict[str, Column]:
    c = r.text("last_name")
    if c is None or not params.get("strip", False):
        return {}
    pattern = "(?i)" + R.NAME_SUFFIX
    has = c.rlike(pattern)
    return {"last_name": F.when(has, X.strip(F.regexp_replace(c, pattern, ""))).otherwise(c), "name_suffix": F.when(has, F.regexp_extract(c, pattern, 1)).otherwise(r.any("name_suffix"))}


def title_acronyms(c: Column, params: dict) -> Column:
    table = {**R.ACRONYMS, **params.get("acronyms", {})}
    pieces = F.regexp_extract_all(c, F.lit(r"(\s+|[,/-]|[^\s,/-]+)"), 1)
    return F.array_join(F.transform(pieces, lambda t: X.lookup(F.lower(t), table, t)), "")


def title_words(c: Column, params: dict) -> Column:
    out = R.TITLE_EXPANSIONS
    table = params.get("mapping", out if params.get("direction", "expand") == "expand" else {v.lower(): k for k, v in out.items()})
    return X.map_tokens(c, lambda t: X.lookup(F.lower(t), table, t))


def legal_suffix(r: Record, params: dict) -> dict[str, Column]:
    c = r.text("company_name")
    if c is None:
        return {}
    table = {**R.LEGAL_SUFFIXES, **params.get("suffixes", {})}
    last = F.element_at(F.split(X.strip(c), " "), -1)
    found = X.lookup(X.rstrip_chars(F.lower(last), ".,"), table)
    head = X.rstrip_chars(F.substring(c, F.lit(1), F.length(c) - F.length(last)), " ,")
    name = head if params.get("mode", "canonicalize") == "strip" else F.concat(head, F.lit(" "), found)
    return {"company_name_normalized": F.when((X.strip(c) != "") & found.isNotNull(), name).otherwise(r.any("company_name_normalized"))}


def company_case(c: Column, params: dict) -> Column:
    table = {**R.BRANDS, **params.get("exceptions", {})}

    def one(t: Column) -> Column:
        bare = X.rstrip_chars(t, ".,")
        brand = X.lookup(F.lower(bare), table)
        return F.when(X.strip(t) == "", t).otherwise(F.coalesce(F.concat(brand, F.substring(t, F.length(bare) + 1, F.length(t))), X.capitalize(t)))

    return X.map_tokens(c, one)


def country_code(c: Column) -> Column:
    s = X.strip(c)
    return F.when((F.length(s) == 2) & F.upper(s).isin(*R.COUNTRY_NAMES), F.upper(s)).otherwise(X.lookup(F.lower(s), R.COUNTRY_CODES))


def e164(c: Column, region: Column) -> Column:
    """International form; null where there is no digit."""
    d = X.digits(c)
    code, size = X.lookup(region, R.CALLING_CODES), X.lookup(region, {k: str(v) for k, v in R.NATIONAL_LENGTHS.items()}).cast("int")
    plain = F.concat(F.lit("+"), d)
    whole = code.isNotNull() & d.startswith(code) & (F.length(d) == F.length(code) + size)
    return F.when(d != "", F.when(X.strip(c).startswith("+") | F.coalesce(whole, F.lit(False)), plain).otherwise(F.concat(F.lit("+"), F.coalesce(code, F.lit("")), d)))


def phones(by_country: bool):
    def apply(r: Record, params: dict) -> dict[str, Column]:
        region = params.get("default_region")
        if not region:
            return {}
        where = F.lit(region)
        if by_country and r.text("country") is not None:
            where = F.coalesce(country_code(r.text("country")), where)
        return {f: F.coalesce(e164(c, where), c) for f in ("direct_phone", "phone") if (c := r.text(f)) is not None}

    return apply


def postal_code(c: Column, params: dict) -> Column:
    if params.get("target", "as_is") != "5_digit":
        return c
    plus4 = r"^(\d{5})-(\d{4})$"
    return F.when(X.strip(c).rlike(plus4), F.regexp_extract(X.strip(c), plus4, 1)).otherwise(c)


def street(r: Record, params: dict) -> dict[str, Column]:
    c, country = r.text("address_line_1"), r.text("country")
    if c is None or country is None or params.get("target", "abbreviated") != "abbreviated":
        return {}
    short = X.map_tokens(c, lambda t: X.lookup(X.rstrip_chars(F.lower(t), ".,"), R.STREET_SUFFIXES, t))
    return {"address_line_1": F.when(country_code(country) == "US", short).otherwise(c)}


def currency(r: Record, params: dict) -> dict[str, Column]:
    return {f"{f}_currency": F.when(r.any(f).isNotNull(), F.lit(params["currency"])) for f in R.MONEY_FIELDS if f in r.columns} if params.get("currency") else {}


def scale(r: Record, params: dict) -> dict[str, Column]:
    factor = R.SCALES.get(params.get("scale", ""))
    return {f: c * factor for f in ("sales_usd", "assets_usd", "liabilities_usd") if (c := r.number(f)) is not None} if factor and factor != 1 else {}


def rounding(r: Record, params: dict) -> dict[str, Column]:
    p = params.get("round_to_nearest")
    return {f"{f}_rounded": F.bround(c / p) * p for f in R.MONEY_FIELDS if (c := r.number(f)) is not None} if p else {}


def url_scheme(c: Column, params: dict) -> Column:
    s = X.strip(c)
    return F.when(~s.rlike(R.URL_SCHEME) & s.rlike(R.BARE_DOMAIN), F.concat(F.lit("https://"), s)).otherwise(c)


# ---- shapes: checks ------------------------------------------------------------------------------------


def missing(*checks: tuple[str, str, str]):
    return lambda r, p: [Draft(~r.present(f), code, message, (f,)) for f, code, message in checks]


def all_absent(code: str, message: str, *fields: str):
    return lambda r, p: [Draft(~reduce(lambda a, b: a | b, [r.present(f) for f in fields]), code, message, fields)]


def is_present(code: str, message: str, name: str):
    return lambda r, p: [Draft(r.present(name), code, message, (name,))]


def identical(code: str, message: str, left: tuple[str, ...], right: str):
    def apply(r: Record, params: dict) -> list[Draft]:
        parts, other = [r.text(f) for f in left], r.text(right)
        if other is None or any(c is None for c in parts):
            return []
        joined = reduce(lambda a, b: F.concat(a, F.lit(" "), b), parts)  # null if any is
        a = F.lower(X.strip(joined))
        return [Draft((a != "") & (a == F.lower(X.strip(other))), code, message, (*left, right))]

    return apply


def threshold(code: str, message: str, name: str, limit: int, above: bool):
    def apply(r: Record, params: dict) -> list[Draft]:
        c = r.text(name)
        n = params.get("threshold", limit)
        if c is None:
            return []
        head, tail = message.replace("{threshold}", str(n)).split("{length}")
        return [Draft((c != "") & ((F.length(c) > n) if above else (F.length(c) < n)), code, F.concat(F.lit(head), F.length(c).cast("string"), F.lit(tail)), (name,))]

    return apply


def digit_count(code: str, least: int, *fields: str):
    def apply(r: Record, params: dict) -> list[Draft]:
        n = params.get("min_digits", least)
        drafts = []
        for f in fields:
            if (c := r.text(f)) is not None:
                count = F.length(X.digits(c))
                drafts.append(Draft((c != "") & (count < n), code, F.concat(F.lit("Only "), count.cast("string"), F.lit(f" digit(s) found, below the {n}-digit plausibility threshold.")), (f,)))
        return drafts

    return apply


def shape(code: str, message: str, pattern: str, *fields: str, invert: bool = False):
    def apply(r: Record, params: dict) -> list[Draft]:
        return [Draft((c != "") & (~c.rlike(pattern) if invert else c.rlike(pattern)), code, message, (f,)) for f in fields if (c := r.text(f)) is not None]

    return apply


def negative(code: str, *fields: str):
    def apply(r: Record, params: dict) -> list[Draft]:
        return [Draft(c < 0, code, F.concat(F.lit(f"{f} is negative ("), X.number(c.cast("double")) if r.kinds.get(f) in ("double", "float") else c.cast("string"), F.lit("), which is implausible for this field.")), (f,)) for f in fields if (c := r.number(f)) is not None]

    return apply


def greater(code: str, message: str, a: str, b: str):
    return lambda r, p: [Draft(r.number(a) > r.number(b), code, message, (a, b))] if r.number(a) is not None and r.number(b) is not None else []


def presence(code: str, message: str, trigger: tuple[str, ...], required: tuple[str, ...], all_trigger: bool = False, all_required: bool = False):
    """Any (or all) of `trigger` present and not any (or not all) of `required`."""

    def some(r: Record, fields: tuple[str, ...], every: bool) -> Column:
        return reduce(lambda x, y: x & y if every else x | y, [r.present(f) for f in fields])

    return lambda r, p: [Draft(some(r, trigger, all_trigger) & ~some(r, required, all_required), code, message, (*trigger, *required))]


def pairs(code: str, *both: tuple[str, str]):
    return lambda r, p: [Draft(r.present(a) != r.present(b), code, f"Exactly one of {a}/{b} is populated.", (a, b)) for a, b in both if a in r.columns or b in r.columns]


def membership(code: str, tables: dict[str, tuple[str, ...]]):
    def apply(r: Record, params: dict) -> list[Draft]:
        return [Draft((X.strip(c) != "") & ~X.strip(c).isin(*known), code, F.concat(F.lit(f"{f} value '"), c, F.lit("' was not found in the bundled reference table.")), (f,)) for f, known in tables.items() if (c := r.text(f)) is not None]

    return apply


def level_and_title(r: Record, params: dict) -> list[Draft]:
    level, title = r.text("contact_level"), r.text("title")
    if level is None or title is None:
        return []
    low, known = F.lower(level), F.lower(title)
    # The first level named decides, whatever the later ones would say.
    fits = F.lit(True)
    for key, words in reversed(R.LEVEL_KEYWORDS.items()):
        fits = F.when(low.contains(key), reduce(lambda a, b: a | b, [known.contains(w) for w in words])).otherwise(fits)
    message = F.concat(F.lit("Contact Level '"), level, F.lit("' but Title '"), title, F.lit("' has no matching keyword (heuristic, low-confidence)."))
    return [Draft((level != "") & title.isNotNull() & ~fits, "CONTACT_LEVEL_TITLE_MISMATCH", message, ("contact_level", "title"))]


def email_shape(r: Record, params: dict) -> list[Draft]:
    drafts = []
    for f in ("email", "company_email"):
        if (c := r.text(f)) is not None:
            ats = F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit("")))
            bad = (ats != 1) | (c.contains("@") & ~F.substring_index(c, "@", -1).contains("."))
            drafts.append(Draft((c != "") & bad, "MALFORMED_EMAIL_SHAPE", F.concat(F.lit("'"), c, F.lit("' does not have the basic shape of an email address.")), (f,)))
    return drafts


def role_inbox(r: Record, params: dict) -> list[Draft]:
    c = r.text("email")
    if c is None:
        return []
    local = F.lower(F.regexp_extract(c, r"^([\s\S]*)@[^@]*$", 1))
    return [Draft(c.contains("@") & local.isin(*params.get("prefixes", R.ROLE_INBOXES)), "ROLE_BASED_EMAIL_PATTERN", F.concat(F.lit("'"), c, F.lit("' looks like a role-based/generic inbox, not a personal one.")), ("email",))]


def ticker_ownership(r: Record, params: dict) -> list[Draft]:
    t, o = r.text("ticker"), r.any("ownership_type")
    if t is None:
        return []
    public = F.coalesce(F.exists(F.split(o, ","), lambda x: F.lower(X.strip(x)) == "public"), F.lit(False))
    message = F.concat(F.lit("Ticker '"), t, F.lit("' present but Ownership Type ('"), F.coalesce(o, F.lit("None")), F.lit("') does not indicate public ownership."))
    return [Draft((X.strip(t) != "") & ~public, "TICKER_WITHOUT_PUBLIC_OWNERSHIP", message, ("ticker", "ownership_type"))]


def address_parts(r: Record, params: dict) -> list[Draft]:
    fields = ("city", "state_or_province", "postal_code")
    n = reduce(lambda a, b: a + b, [r.present(f).cast("int") for f in fields])
    return [Draft((n > 0) & (n < 3), "INCOMPLETE_ADDRESS_COMPONENTS", "Only some of City/State/Postal Code are populated.", fields)]


def postal_shape(r: Record, params: dict) -> list[Draft]:
    c, country = r.text("postal_code"), r.text("country")
    if c is None or country is None:
        return []
    bad = F.lit(False)
    for code, pattern in R.POSTAL_SHAPES.items():
        bad = bad | ((country_code(country) == code) & ~X.strip(c).rlike(pattern))
    message = F.concat(F.lit("'"), c, F.lit("' does not match the expected shape for "), F.coalesce(country, F.lit("None")), F.lit("."))
    return [Draft((c != "") & bad, "POSTAL_CODE_SHAPE_UNEXPECTED", message, ("postal_code", "country"))]


def url_shape(r: Record, params: dict) -> list[Draft]:
    c = r.text("url")
    if c is None:
        return []
    s = X.strip(c)
    return [Draft((s != "") & ~s.rlike(R.URL_SCHEME) & ~s.rlike(R.BARE_DOMAIN), "MALFORMED_URL_SHAPE", F.concat(F.lit("'"), c, F.lit("' does not look like a URL or a bare domain.")), ("url",))]


def domains_differ(r: Record, params: dict) -> list[Draft]:
    e, u = r.text("email"), r.text("url")
    if e is None or u is None:
        return []
    a, b = X.domain_of_email(e), X.domain_of_url(u)
    message = F.concat(F.lit("Email domain '"), a, F.lit("' does not match company domain '"), b, F.lit("'."))
    return [Draft((a != b) & ~a.isin(*params.get("generic_domains", R.GENERIC_DOMAINS)), "EMAIL_DOMAIN_COMPANY_DOMAIN_MISMATCH", message, ("email", "url"))]


# ---- what counts as affected -----------------------------------------------------------------------------


def has_token(name: str, table: dict, pattern: str = r"(\s+|\S+)", bare: bool = False, when: Callable[[Record], Column] | None = None):
    """A word of the text stands in the table, whether or not it is written as there."""

    def touches(r: Record, params: dict) -> Column:
        c = r.text(name)
        if c is None:
            return F.lit(False)
        key = lambda t: X.rstrip_chars(F.lower(t), ".,") if bare else F.lower(t)
        found = F.exists(F.regexp_extract_all(c, F.lit(pattern), 1), lambda t: key(t).isin(*table))
        return found & when(r) if when else found

    return touches


def has_value(*names: str):
    """One of the numbers is there."""
    return lambda r, p: reduce(lambda a, b: a | b, [r.number(n).isNotNull() for n in names if r.number(n) is not None], F.lit(False))


# ---- configuration checks --------------------------------------------------------------------------------


def needs(rule_id: str, name: str, ok: Callable[[Any], bool] = bool):
    def validate(profile) -> None:
        if profile.enabled(rule_id) and not ok(profile.params(rule_id).get(name)):
            raise ConfigurationError(f"{rule_id} is enabled but its parameter '{name}' is missing or invalid.")

    return validate


def country_phones(profile) -> None:
    needs("CLN-067", "default_region")(profile)
    if profile.enabled("CLN-067") and profile.enabled("CLN-016"):
        raise ConfigurationError("CLN-067 and CLN-016 exclude each other.")


# ---- the registry, in order ---------------------------------------------------------------------------------

_CODES, _DESCRIPTIONS = tuple(a for a, _ in R.CODE_PAIRS), tuple(b for _, b in R.CODE_PAIRS)
_DISCLAIMER = "Dedup ID is populated but is not a reliable per-contact unique key (confirmed during Import Engine dataset profiling: unrelated companies were observed sharing the same Dedup ID value). Do not rely on it for deduplication."


def _registry() -> list[Rule]:
    out: list[Rule] = []

    def safe(n, category, name, fields, apply, writes=()):
        out.append(Rule(f"CLN-{n:03}", name, category, SAFE, fields, apply, True, writes or fields, total=True))

    def business(n, category, name, fields, apply, default, writes=(), validate=None, touches=None, total=True):
        out.append(Rule(f"CLN-{n:03}", name, category, BUSINESS, fields, apply, default, writes or fields, validate, touches, total=total))

    def check(n, category, name, fields, apply):
        out.append(Rule(f"CLN-{n:03}", name, category, WARNING, fields, apply, total=True))

    names = ("first_name", "last_name")
    f = (*names, "title", "contact_level", "job_function")
    safe(1, "identity", "Trim identity text", f, whitespace(*f))
    business(2, "identity", "Name casing", names, each(name_case, *names), True)
    business(3, "identity", "Name suffix", ("last_name",), name_suffix, False, ("last_name", "name_suffix"))
    business(4, "identity", "Title acronyms", ("title",), each(title_acronyms, "title"), True, touches=has_token("title", R.ACRONYMS, r"(\s+|[,/-]|[^\s,/-]+)"))
    business(5, "identity", "Title abbreviations", ("title",), each(title_words, "title"), False, touches=has_token("title", R.TITLE_EXPANSIONS))
    check(6, "identity", "Missing name", names, missing(("first_name", "MISSING_FIRST_NAME", "First Name is missing."), ("last_name", "MISSING_LAST_NAME", "Last Name is missing.")))
    check(7, "identity", "First equals last name", names, identical("IDENTICAL_FIRST_LAST_NAME", "First Name and Last Name are identical.", ("first_name",), "last_name"))
    check(8, "identity", "Unexpected characters in a name", names, shape("UNEXPECTED_CHARACTERS_IN_NAME", "Name field contains characters outside the expected allow-list.", r"(?U)[^A-Za-z\s\-'À-ɏ]", *names))
    check(9, "identity", "Long title", ("title",), threshold("TITLE_UNUSUALLY_LONG", "Title is {length} characters, exceeding the {threshold}-character threshold.", "title", 100, True))
    check(10, "identity", "Contact level against title", ("contact_level", "title"), level_and_title)
    emails, dialed = ("email", "company_email"), ("direct_phone", "phone")
    safe(11, "contact", "Trim emails", emails, whitespace(*emails, remove_all=True))
    safe(12, "contact", "Phone force-text mark", (*dialed, "fax"), whitespace(*dialed, "fax", artifact="^'+"))
    safe(13, "contact", "Email domain case", emails, email_side(True))
    business(14, "contact", "Email local part case", emails, email_side(False), True)
    business(15, "contact", "Primary email", emails, primary(*emails, to="primary_email"), True, ("primary_email",))
    business(16, "contact", "International phones", dialed, phones(False), False, dialed, needs("CLN-016", "default_region"))
    business(17, "contact", "Primary phone", dialed, primary(*dialed, to="primary_phone"), True, ("primary_phone",))
    check(18, "contact", "Missing email", ("email",), missing(("email", "MISSING_EMAIL", "Email is missing.")))
    check(19, "contact", "Malformed email", emails, email_shape)
    check(20, "contact", "Role inbox", ("email",), role_inbox)
    check(21, "contact", "Missing phone", dialed, all_absent("MISSING_PHONE", "Neither Direct Phone nor Phone is populated.", *dialed))
    check(22, "contact", "Few digits in a phone", dialed, digit_count("IMPLAUSIBLE_PHONE_DIGIT_COUNT", 7, *dialed))
    check(23, "contact", "Letters in a phone", dialed, shape("PHONE_CONTAINS_LETTERS", "Phone value contains letters.", "[A-Za-z]", *dialed))
    f = ("company_name", "tradestyle", "ownership_type", "entity_type", "parent_company", "global_ultimate_company", "business_description")
    safe(24, "company", "Trim company text", f, whitespace(*f))
    safe(25, "company", "Trim company number", ("duns_number",), ends_only("duns_number"))
    business(26, "company", "Legal suffix", ("company_name",), legal_suffix, False, ("company_name_normalized",))
    business(27, "company", "Company casing", ("company_name",), each(company_case, "company_name"), False)
    business(28, "company", "Headquarters flag", ("is_headquarters",), booleans("is_headquarters"), True)
    check(29, "company", "Missing company", ("company_name",), missing(("company_name", "MISSING_COMPANY_NAME", "Company Name is missing.")))
    check(30, "company", "Company equals parent", ("company_name", "parent_company"), identical("COMPANY_EQUALS_PARENT", "Company Name and Parent Company are identical.", ("company_name",), "parent_company"))
    check(31, "company", "Ticker without public ownership", ("ticker", "ownership_type"), ticker_ownership)
    check(32, "company", "Short description", ("business_description",), threshold("BUSINESS_DESCRIPTION_SUSPICIOUSLY_SHORT", "Business Description is only {length} characters, below the {threshold}-character threshold.", "business_description", 10, False))
    check(33, "company", "Company number shape", ("duns_number",), shape("DUNS_SHAPE_UNEXPECTED", "D-U-N-S Number does not match the expected 9-digit numeric shape.", r"^\d{9}$", "duns_number", invert=True))
    check(34, "company", "Missing key id", ("key_id",), missing(("key_id", "MISSING_KEY_ID", "Key ID is missing.")))
    lines = ("address_line_1", "address_line_2", "address_line_3")
    f = (*lines, "city", "state_or_province", "postal_code", "country")
    safe(35, "address", "Trim address text", f, whitespace(*f))
    safe(36, "address", "Empty address lines", lines, missing_values(*lines))
    business(37, "address", "State or province", ("state_or_province",), standardize("state_or_province", R.STATE_CODES, R.STATE_NAMES), False)
    business(38, "address", "Country", ("country",), standardize("country", R.COUNTRY_CODES, R.COUNTRY_NAMES), False)
    business(39, "address", "Postal code", ("postal_code",), each(postal_code, "postal_code"), False)
    business(40, "address", "Street words", ("address_line_1", "country"), street, False, ("address_line_1",), touches=has_token("address_line_1", R.STREET_SUFFIXES, bare=True, when=lambda r: F.coalesce(country_code(r.any("country")) == "US", F.lit(False))))
    check(41, "address", "Incomplete address", ("city", "state_or_province", "postal_code"), address_parts)
    check(42, "address", "Postal code shape", ("postal_code", "country"), postal_shape)
    check(43, "address", "Address line equals city", ("address_line_1", "city"), identical("ADDRESS_LINE_DUPLICATES_CITY", "Address Line 1 duplicates City.", ("address_line_1",), "city"))
    safe(44, "financial", "Missing numbers", R.NUMERIC_FIELDS, missing_values(*R.NUMERIC_FIELDS, sentinels=("", "n/a", "null")))
    tags, rounded = tuple(f"{m}_currency" for m in R.MONEY_FIELDS), tuple(f"{m}_rounded" for m in R.MONEY_FIELDS)
    business(45, "financial", "Currency tag", R.MONEY_FIELDS, currency, False, tags, needs("CLN-045", "currency"))
    business(46, "financial", "Unit scale", ("sales_usd", "assets_usd", "liabilities_usd"), scale, False, (), needs("CLN-046", "scale", lambda s: s in R.SCALES), has_value("sales_usd", "assets_usd", "liabilities_usd"), total=False)  # decimals may overflow
    business(47, "financial", "Rounding", R.MONEY_FIELDS, rounding, False, rounded, total=False)
    check(48, "financial", "Negative value", ("sales_usd", "assets_usd", "employees_total"), negative("IMPLAUSIBLE_NEGATIVE_VALUE", "sales_usd", "assets_usd", "employees_total"))
    check(49, "financial", "Site above total", ("employees_single_site", "employees_total"), greater("SINGLE_SITE_EXCEEDS_TOTAL_EMPLOYEES", "Employees (Single Site) exceeds Employees (Total).", "employees_single_site", "employees_total"))
    f = ("assets_usd", "pre_tax_profit_usd", "liabilities_usd")
    check(50, "financial", "Financials without sales", (*f, "sales_usd"), presence("FINANCIAL_DATA_WITHOUT_SALES", "A financial field is populated while Sales (USD) is absent.", f, ("sales_usd",)))
    safe(51, "industry", "Trim industry text", ("industry_label", *_DESCRIPTIONS), whitespace("industry_label", *_DESCRIPTIONS))
    safe(52, "industry", "Trim codes", _CODES, ends_only(*_CODES))
    check(53, "industry", "Code and description", (*_CODES, *_DESCRIPTIONS), pairs("CODE_DESCRIPTION_PAIR_INCOMPLETE", *R.CODE_PAIRS))
    check(54, "industry", "Unknown code", tuple(R.KNOWN_CODES), membership("UNRECOGNIZED_CLASSIFICATION_CODE", R.KNOWN_CODES))
    check(55, "industry", "Code without label", (*_CODES, "industry_label"), presence("INDUSTRY_LABEL_MISSING", "A classification code is populated while D&B Hoovers Industry is absent.", _CODES, ("industry_label",)))
    f = ("source", "direct_marketing_status", "url", "email_usage_restriction", "direct_phone_usage_restriction")
    safe(56, "metadata", "Trim metadata", f, whitespace(*f))
    business(57, "metadata", "URL scheme", ("url",), each(url_scheme, "url"), False)
    business(58, "metadata", "Preference flag", ("tps_flag",), booleans("tps_flag"), True)
    safe(59, "metadata", "Provenance passes through", ("row_number", "sheet_name"), lambda r, p: {})
    check(60, "metadata", "Missing source", ("source",), missing(("source", "MISSING_SOURCE", "Source is missing.")))
    check(61, "metadata", "Malformed URL", ("url",), url_shape)
    check(62, "metadata", "Dedup id disclaimer", ("dedup_id",), is_present("DEDUP_ID_NOT_RELIABLE", _DISCLAIMER, "dedup_id"))
    check(63, "cross_field", "No contact method", ("email", *dialed), all_absent("NO_CONTACT_METHOD_AVAILABLE", "Email, Direct Phone, and Phone are all absent — no contact method available.", "email", *dialed))
    check(64, "cross_field", "Name equals company", (*names, "company_name"), identical("NAME_DUPLICATES_COMPANY_NAME", "First Name + Last Name duplicates Company Name.", names, "company_name"))
    check(65, "cross_field", "Address equals company", ("address_line_1", "company_name"), identical("ADDRESS_DUPLICATES_COMPANY_NAME", "Address Line 1 duplicates Company Name.", ("address_line_1",), "company_name"))
    check(66, "cross_field", "Email and company domains", ("email", "url"), domains_differ)
    business(67, "cross_field", "International phones by country", ("country", *dialed), phones(True), False, dialed, country_phones)
    f = ("industry_label", *_CODES)
    check(68, "cross_field", "Sales without industry", ("sales_usd", *f), presence("FINANCIAL_DATA_WITHOUT_INDUSTRY_CLASSIFICATION", "Sales (USD) is populated while no industry classification field is populated.", ("sales_usd",), f))
    return out


RULES: list[Rule] = _registry()
