"""Reports: a row a subject, summaries of a run, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_VERIFIED = ("no_email", "not_configured", "error")
PROVIDER_ORDER = ("company_crawler", "press_release", "google_web_search", "linkedin_search", "news_search")


def status(compared: Column, errors: Column) -> Column:
    """failed without a comparison, partial with a stage error, else success."""
    return F.when(~compared, "failed").when(F.size(errors) > 0, "partial").otherwise("success")


def rows(subjects: DataFrame, observations: DataFrame, summaries: DataFrame, events: DataFrame, verified: DataFrame) -> DataFrame:
    """One flat row a subject.

    subjects: subject_id, executive_name, company, email, url, has_observations, providers (array), errors (array).
    observations: subject_id, provider_id.  summaries: ref and counts.  events: ref, type.  verified: subject_id, status."""
    count = observations.groupBy("subject_id").agg(*[F.count_if(F.col("provider_id") == p).alias(a) for p, a in (("company_website", "company_website_results_found"), ("google_search", "google_results_found"))])
    said = F.concat_ws(" ", *[F.concat(F.lit(f"{a}="), F.col(c).cast("string")) for a, c in (("matched", "match"), ("changed", "changed"), ("missing", "missing"), ("new", "new"), ("conflict", "conflict"), ("unknown", "unknown"))], F.concat(F.lit("confidence="), F.format_string("%.2f", F.col("confidence"))))
    summary = summaries.select(F.col("ref").alias("subject_id"), said.alias("comparison_summary"))
    types = events.groupBy(F.col("ref").alias("subject_id")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    verdicts = verified.groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("verdicts"))
    out = subjects
    for part in (count, summary, types, verdicts):
        out = out.join(part, "subject_id", "left")
    failed_check = F.exists("errors", lambda e: e.contains("Verification failed"))
    verification = F.coalesce("verdicts", F.when(F.coalesce("email", F.lit("")) == "", "no_email").when(failed_check, "error").otherwise("not_configured"))
    return out.select(
        "subject_id", "executive_name", "company", F.col("url").alias("website_searched"), F.array_join("providers", ",").alias("providers_executed"),
        F.coalesce("company_website_results_found", F.lit(0)).alias("company_website_results_found"), F.coalesce("google_results_found", F.lit(0)).alias("google_results_found"),
        F.coalesce("comparison_summary", F.lit("not_compared")).alias("comparison_summary"),
        F.when(~F.col("has_observations"), "not_detected").otherwise(F.coalesce("types", F.lit("none"))).alias("inflections_detected"),
        verification.alias("verification_status"), status(F.col("comparison_summary").isNotNull(), F.col("errors")).alias("status"), F.array_join("errors", "; ").alias("errors"),
    )


def error_row(subject_id: Column, name: Column, error: Column) -> Column:
    """The row of a subject whose processing broke off."""
    zero = F.lit(0).cast("long")
    return F.struct(subject_id.alias("subject_id"), name.alias("executive_name"), F.lit("").alias("providers_executed"), zero.alias("company_website_results_found"), zero.alias("google_results_found"), F.lit("not_compared").alias("comparison_summary"), F.lit("not_detected").alias("inflections_detected"), F.lit("error").alias("verification_status"), F.lit("failed").alias("status"), error.alias("errors"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def summary(report: DataFrame) -> DataFrame:
    """The nine figures of a run, as one row."""
    has = lambda c, v: F.array_contains(F.split(F.col(c), ","), v)
    counted = ~F.col("verification_status").isin(*NOT_VERIFIED)
    return report.agg(
        F.count("*").alias("total_executives_processed"), _share(F.count_if(F.col("status") == "success"), F.count("*")).alias("success_rate"),
        F.count_if(F.col("errors").contains("Enrichment (")).alias("failed_searches"), F.count_if(F.col("company_website_results_found") > 0).alias("company_websites_found"),
        F.count_if(has("providers_executed", "google_search")).alias("google_searches_completed"), F.count_if(has("inflections_detected", "promotion")).alias("promotions_detected"),
        F.count_if(has("inflections_detected", "company_change")).alias("company_changes_detected"), F.count_if(has("inflections_detected", "executive_no_longer_found")).alias("missing_executives"),
        _share(F.count_if(counted & has("verification_status", "valid")), F.count_if(counted)).alias("verification_success_rate"),
    )


def inflection_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("events"), F.countDistinct("ref").alias("subjects"))


def batch_statistics(report: DataFrame) -> DataFrame:
    """Subjects by status, and errors in all."""
    errors = F.coalesce(F.sum(F.when(F.col("errors") == "", 0).otherwise(F.size(F.split("errors", "; ")))), F.lit(0))
    return report.agg(F.count("*").alias("subjects"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "failed")], errors.cast("long").alias("errors"))


def executed_in_order(providers: Column) -> Column:
    """Names of the search providers that ran, in their fixed order."""
    return F.array_join(F.filter(F.array(*[F.lit(p) for p in PROVIDER_ORDER]), lambda p: F.array_contains(providers, p)), ",")


def write_csv(report: DataFrame, path: str) -> None:
    """A header and a row a subject; null as nothing.  One file: a report is as long as the list of people it is about."""
    report.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in report.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json(run: DataFrame, path: str) -> None:
    run.select(F.to_json(F.struct(*run.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_both(report: DataFrame, run: DataFrame, folder: str) -> None:
    write_csv(report, f"{folder}/rows")
    write_json(run, f"{folder}/summary")
