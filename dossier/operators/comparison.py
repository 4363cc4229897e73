"""Stored records against new evidence, field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X
from dossier.operators.rules import ConfigurationError


@dataclass(frozen=True)
class ComparisonProfile:
    """rules: (field, exact or fuzzy, threshold, observed attribute)."""

    rules: tuple = tuple(R.COMPARED)

    def validate(self) -> None:
        names = [r[0] for r in self.rules]
        if not names or len(set(names)) < len(names):
            raise ConfigurationError("field rules must be there and unique")
        if set(names) - {r[0] for r in R.COMPARED}:
            raise ConfigurationError("a field has no resolver")
        if any(s == "fuzzy" and not 0 <= t <= 1 for _, s, t, _ in self.rules):
            raise ConfigurationError("thresholds lie within 0 and 1")


def resolved(records: DataFrame) -> dict[str, Column]:
    """The five fields of a record, each from the first of its columns that holds something."""
    c = lambda n: F.col(n) if n in records.columns else F.lit(None).cast("string")
    some = (F.coalesce(c("first_name"), F.lit("")) != "") | (F.coalesce(c("last_name"), F.lit("")) != "")
    name = F.when(some, X.blank_to_null(F.concat(F.coalesce(c("first_name"), F.lit("")), F.lit(" "), F.coalesce(c("last_name"), F.lit("")))))
    return {
        "name": name,
        "title": X.first_present(c("title")),
        "company": X.first_present(c("company_name_normalized"), c("company_name")),
        "email": X.first_present(c("primary_email"), c("email"), c("company_email")),
        "phone": X.first_present(c("primary_phone"), c("direct_phone"), c("phone")),
    }


def existing_values(records: DataFrame, ref: str) -> DataFrame:
    """ref, field, existing: one row for each of the five fields."""
    values = resolved(records)
    rows = [F.struct(F.lit(k).alias("position"), F.lit(f).alias("field"), v.alias("existing")) for k, (f, v) in enumerate(values.items())]
    return records.select(F.col(ref).alias("ref"), F.explode(F.array(*rows)).alias("x")).select("ref", "x.*")


def key_of(field: Column, value: Column) -> Column:
    """Under which form two values of a field are the same."""
    plus = F.when(X.strip(value).startswith("+"), "+").otherwise("")
    return F.when(field == "email", F.lower(X.strip(value))).when(field == "phone", F.concat(plus, X.digits(value))).otherwise(X.collapse(value))


def new_values(observations: DataFrame, profile: ComparisonProfile | None = None) -> DataFrame:
    """ref, field, found: the distinct values (the least spelling of each), sorted.  observations: subject_id, attribute, value."""
    profile = profile or ComparisonProfile()
    attributes = {a: f for f, _, _, a in profile.rules}
    rows = observations.where(F.col("attribute").isin(*attributes)).select(F.col("subject_id").alias("ref"), X.lookup(F.col("attribute"), attributes).alias("field"), X.strip(F.col("value")).alias("raw")).where("raw <> ''")
    least = rows.groupBy("ref", "field", key_of(F.col("field"), F.col("raw")).alias("key")).agg(F.min("raw").alias("raw"))
    return least.groupBy("ref", "field").agg(F.array_sort(F.collect_list("raw")).alias("found"))


def verdicts(records: DataFrame, ref: str, observations: DataFrame, profile: ComparisonProfile | None = None, fuzzy: bool = True, scores: bool = True) -> DataFrame:
    """Five rows a record: ref, field, existing, new, status, strategy, similarity, conflicting, explanation, settled.

    fuzzy=False compares every field by its key alone, without a Python worker.  scores=False asks for the statuses only:
    where bounds of the similarity say on which side of the threshold it lies, it is not computed (null).
    settled: what said so: key, form (a closed form of the ratio), bounds or difflib."""
    profile = profile or ComparisonProfile()
    profile.validate()
    strategy = {f: (s if fuzzy else "exact") for f, s, _, _ in profile.rules}
    limits = {f: float(t if t is not None and fuzzy else 1.0) for f, _, t, _ in profile.rules}
    wanted = existing_values(records, ref).where(F.col("field").isin(*strategy))
    out = wanted.join(new_values(observations, profile), ["ref", "field"], "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    one = F.when(n == 1, F.element_at("found", 1))
    out = out.withColumns({"new": one, "strategy": X.lookup(F.col("field"), strategy), "n_new": F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))})
    same = key_of(F.col("field"), F.col("existing")) == key_of(F.col("field"), F.col("new"))
    exact = F.when(F.col("existing").isNotNull() & F.col("new").isNotNull(), same.cast("double"))
    if fuzzy:
        # Only pairs that a key cannot settle cross to Python: the others get a null there.
        hard = (F.col("strategy") == "fuzzy") & ~same & F.col("existing").isNotNull() & F.col("new").isNotNull()
        a, b = F.col("_a"), F.col("_b")
        out = out.withColumns({"_a": F.when(hard, X.collapse(F.col("existing"))), "_b": F.when(hard, X.collapse(F.col("new"))), "_limit": X.lookup(F.col("field"), limits)})
        out = out.withColumn("_known", X.ratio_known(a, b))
        low, high = X.ratio_bounds(a, b)
        side = F.when(F.col("_known").isNull() & a.isNotNull(), F.when(high < F.col("_limit"), "below").when(low >= F.col("_limit"), "above")) if not scores else F.lit(None).cast("string")
        out = out.withColumn("_side", side)
        open_ = F.col("_known").isNull() & F.col("_side").isNull()
        out = out.withColumn("similarity", F.coalesce(X.sequence_ratio(F.when(open_, a), F.when(open_, b)), "_known", F.when(F.col("_side").isNull(), exact)))
        settled = F.when(a.isNull(), F.when(exact.isNotNull(), "key")).when(F.col("_side").isNotNull(), "bounds").when(F.col("_known").isNotNull(), "form").otherwise("difflib")
        out = out.withColumn("settled", settled).drop("_a", "_b", "_known", "_limit")
    else:
        out = out.withColumns({"similarity": exact, "_side": F.lit(None).cast("string"), "settled": F.when(exact.isNotNull(), "key")})
    old = F.col("existing").isNotNull()
    match = F.coalesce(F.col("_side") == "above", F.col("similarity") >= X.lookup(F.col("field"), limits))
    status = F.when(~old & (F.col("n_new") == 0), "unknown").when(F.col("n_new") > 1, "conflict").when(F.col("n_new") == 0, "missing").when(~old, "new").when(match, "match").otherwise("changed")
    out = out.withColumn("status", status)
    compared = F.col("status").isin("match", "changed")
    explanation = (
        F.when(F.col("status") == "unknown", "No data available from either the existing record or new observations.")
        .when(F.col("status") == "conflict", F.concat(F.col("n_new").cast("string"), F.lit(" differing new value(s) found for this field: "), F.array_join("found", ", "), F.lit(".")))
        .when(F.col("status") == "missing", "Existing value present; no corresponding new observation was found.")
        .when(F.col("status") == "new", "No existing value; a new observation provides one.")
        .otherwise(F.concat(F.col("strategy"), F.lit(" comparison: "), F.when(F.col("status") == "match", "equivalent").otherwise("differs"), F.when(F.col("_side").isNotNull(), ".").otherwise(F.concat(F.lit(" (score="), F.format_string("%.3f", F.bround("similarity", 3)), F.lit(").")))))
    )
    return out.select("ref", "position", "field", "existing", "new", "status", "strategy", F.when(compared, F.col("similarity")).alias("similarity"), F.when(F.col("status") == "conflict", F.col("found")).alias("conflicting"), explanation.alias("explanation"), F.when(compared, F.col("settled")).alias("settled"))


def summaries(compared: DataFrame) -> DataFrame:
    """Counts by status and the confidence of each record's comparison."""
    statuses = ("match", "changed", "missing", "new", "conflict", "unknown")
    out = compared.groupBy("ref").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    clean = F.col("match") + F.col("changed") + F.col("missing") + F.col("new")
    comparable = F.col("n") - F.col("unknown")
    return out.withColumn("confidence", F.when(comparable > 0, clean / comparable).otherwise(0.0)).drop("n")


def change_list(compared: DataFrame) -> DataFrame:
    """ref, changes: `field: old -> new` of the changed fields, in field order."""
    text = F.concat(F.col("field"), F.lit(": "), F.col("existing"), F.lit(" -> "), F.col("new"))
    return compared.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "changed", F.struct("position", text.alias("t"))))), lambda x: x["t"]), "; ").alias("changes"))
