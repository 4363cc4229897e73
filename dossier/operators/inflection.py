"""Career and contact changes as typed events, and the messages they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X
from dossier.operators.rules import ConfigurationError


def seniority(title: Column) -> Column:
    """Rank of a title: of the keywords it contains the longest decides, then the higher rank; null: none.
    Containment is by substring, so `contractor` holds `cto`."""
    low = F.lower(X.strip(title))
    found = [F.when(low.contains(k), F.struct(F.lit(len(k)).alias("n"), F.lit(r).alias("rank"))) for k, r in R.SENIORITY]
    return F.array_max(F.array(*found))["rank"]


def detect(compared: DataFrame, overrides: dict[str, float] | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """ref, rule_id, type, confidence, explanation, fields: 0 to 7 rows a record.  One aggregation by record."""
    overrides = overrides or {}
    if any(not 0 <= v <= 1 for v in overrides.values()):
        raise ConfigurationError("a base confidence lies within 0 and 1")
    fields = ("name", "title", "company", "email", "phone")
    told, clean = F.count_if(F.col("status") != "unknown"), F.count_if(F.col("status").isin("match", "changed", "missing", "new"))
    certainty = F.when(told > 0, clean / told).otherwise(0.0)  # the confidence of the record's comparison
    wide = compared.groupBy("ref").agg(*[F.max(F.when(F.col("field") == f, F.struct("status", "existing", "new"))).alias(f) for f in fields], certainty.alias("certainty"))
    status, old, new = (lambda f: F.col(f)["status"]), (lambda f: F.col(f)["existing"]), (lambda f: F.col(f)["new"])
    is_ = lambda f, s: F.coalesce(status(f) == s, F.lit(False))
    wide = wide.withColumns({"old_rank": F.when(is_("title", "changed"), seniority(old("title"))), "new_rank": F.when(is_("title", "changed"), seniority(new("title")))})
    confirmed = is_("title", "changed") | is_("company", "changed") | is_("email", "changed") | is_("phone", "changed")
    quote = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    ranked = lambda c, r: F.concat(quote(c), F.lit(" (seniority rank "), F.col(r).cast("string"), F.lit(")"))
    moved = lambda way: F.concat(F.lit("Title changed from "), ranked(old("title"), "old_rank"), F.lit(" to "), ranked(new("title"), "new_rank"), F.lit(f", a move to a {way} senior title."))
    contact = F.array_join(F.filter(F.array(*[F.when(is_(f, "changed"), F.concat(F.lit(f"{f} changed from "), quote(old(f)), F.lit(" to "), quote(new(f)))) for f in ("email", "phone")]), lambda x: x.isNotNull()), "; ")
    cases = {
        "promotion": (F.col("new_rank") > F.col("old_rank"), moved("more"), ["title"]),
        "demotion": (F.col("new_rank") < F.col("old_rank"), moved("less"), ["title"]),
        "company_change": (is_("company", "changed"), F.concat(F.lit("Company changed from "), quote(old("company")), F.lit(" to "), quote(new("company")), F.lit(".")), ["company"]),
        "possible_resignation": (is_("title", "missing") & ~is_("name", "missing") & ~confirmed, F.concat(F.lit("Title "), quote(old("title")), F.lit(" is no longer confirmed by any new observation, though the executive's name is still recognized — possibly a resignation or role change.")), ["title", "name"]),
        "contact_info_changed": (is_("email", "changed") | is_("phone", "changed"), F.concat(F.lit("Contact information changed: "), contact, F.lit(".")), ["email", "phone"]),
        "executive_newly_appeared": (is_("name", "new"), F.concat(F.lit("No existing name was on record; a new observation identifies this executive as "), quote(new("name")), F.lit(".")), ["name"]),
        "executive_no_longer_found": (is_("name", "missing") & ~confirmed, F.concat(F.lit("Existing name "), quote(old("name")), F.lit(" is no longer confirmed by any new observation.")), ["name"]),
    }
    found = []
    for position, (rule_id, kind, base) in enumerate(R.INFLECTIONS):
        if rule_id in disabled:
            continue
        when, text, used = cases[kind]
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(overrides.get(rule_id, base)) * F.col("certainty")))
        found.append(F.when(when, F.struct(F.lit(position).alias("position"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("type"), confidence.alias("confidence"), text.alias("explanation"), F.lit(",".join(used)).alias("fields"))))
    return wide.select("ref", F.explode(F.array(*found)).alias("x")).where("x is not null").select("ref", "x.*")


def strongest(events: DataFrame) -> DataFrame:
    """ref, type, confidence, explanation of the surest event; of equals the first rule's."""
    best = F.max_by(F.struct("type", "confidence", "explanation"), F.struct("confidence", (-F.col("position")).alias("first")))
    return events.groupBy("ref").agg(best.alias("x")).select("ref", "x.*")


def message(kind: Column, name: Column, company: Column, title: Column) -> Column:
    template = X.lookup(kind, R.MESSAGES, F.lit(R.FALLBACK_MESSAGE))
    company = F.coalesce(F.when(company != "", company), F.lit(R.UNKNOWN_COMPANY))
    title = F.coalesce(F.when(title != "", title), F.lit(R.UNKNOWN_TITLE))
    # Pieces between the places, so that a brace in a value is not taken for one.
    filled = F.transform(F.regexp_extract_all(template, F.lit(r"(\{[a-z]+\}|[^{]+)"), 1), lambda p: F.when(p == "{name}", name).when(p == "{company}", company).when(p == "{title}", title).otherwise(p))
    return F.array_join(filled, "")


def current_values(compared: DataFrame) -> DataFrame:
    """ref and each field's current value: the new one where it is changed or new, else the stored one."""
    now = F.when(F.col("status").isin("changed", "new"), F.col("new")).otherwise(F.col("existing"))
    return compared.groupBy("ref").agg(*[F.max(F.when(F.col("field") == f, now)).alias(f) for f, *_ in R.COMPARED])


def messages(events: DataFrame, compared: DataFrame) -> DataFrame:
    """ref, type, message for records with an event."""
    out = strongest(events).join(current_values(compared), "ref")
    return out.select("ref", "type", message(F.col("type"), F.coalesce("name", F.lit("")), F.col("company"), F.col("title")).alias("message"))
