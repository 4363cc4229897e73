"""From records to a run: every stage over all subjects at once, with what went wrong kept as data.

The stages are those of one subject's processing: identity, evidence (landed before), comparison,
inflections, verification, the stored table and messages.  A stage that broke off for a subject is a row
of `failures`; it costs the subject that stage's result, never the other subjects theirs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.cut import checkpointed
from dossier.operators import comparison, evaluation, evidence, identity, inflection, providers, storage

#: In the order in which they run, and in which their errors are told.
STAGES = ("Identity resolution", "Enrichment (person)", "Enrichment (company)", "Search", "Search extraction", "Comparison", "Inflection detection", "Verification")
NO_NAME = "No executive name could be resolved from the existing record."


@dataclass(frozen=True)
class Run:
    """reports: a row a subject.  identities: ref, decision, candidates.  verdicts, events, messages: by ref.
    stored: the persisted table after the run, with fields_updated."""

    reports: DataFrame
    identities: DataFrame
    verdicts: DataFrame
    events: DataFrame
    messages: DataFrame
    stored: DataFrame


def process(
    records: DataFrame, ref: str, observations: DataFrame, stored: DataFrame, now: Column, *, executed: DataFrame | None = None, verified: DataFrame | None = None,
    failures: DataFrame | None = None, profile: comparison.ComparisonProfile | None = None, identities: identity.IdentityProfile | None = None,
) -> Run:
    """Processes all records (cleaned columns and a unique ref).

    observations: subject_id, attribute, value, provider_id.  stored: the persisted table.  executed: subject_id,
    provider_id in order of `place`.  verified: subject_id, status.  failures: subject_id, stage (one of STAGES), error.

    A record without a name fails before any stage.  A subject without observations is compared, but not
    searched for inflections: nothing was looked at, so nothing can be missed."""
    spark = records.sparkSession
    failures = spark.createDataFrame([], "subject_id string, stage string, error string") if failures is None else failures
    executed = spark.createDataFrame([], "subject_id string, provider_id string, place int") if executed is None else executed
    verified = spark.createDataFrame([], "subject_id string, status string") if verified is None else verified
    values = comparison.resolved(records)
    known = records.where(values["name"].isNotNull())
    broke = lambda stage: failures.where(F.col("stage") == stage).select(F.col("subject_id").alias("ref"))

    found = identity.resolve(known, ref, identity.stored_signals(stored), profile=identities)
    outcomes = found["outcomes"].join(broke("Identity resolution"), "ref", "left_anti")
    # Five rows a subject, which the summaries, events, messages and the stored table all read: compared once.
    compared = checkpointed(comparison.verdicts(known, ref, observations, profile).join(broke("Comparison"), "ref", "left_anti"))
    evident = observations.select(F.col("subject_id").alias("ref")).distinct()
    judged = compared.join(evident, "ref", "left_semi").join(broke("Inflection detection"), "ref", "left_anti")
    events = inflection.detect(judged)
    messages = inflection.messages(events, judged)

    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    told = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.concat("stage", F.lit(" failed: "), "error").alias("text")))), lambda x: x["text"])
    errors = failures.groupBy("subject_id").agg(told.alias("_errors"))
    ran = executed.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "provider_id"))), lambda x: x["provider_id"]).alias("_ran"))
    rows = records.select(F.col(ref).alias("subject_id"), values["name"].alias("executive_name"), values["company"].alias("company"), values["email"].alias("email"), _own(records, "url").alias("url"))
    rows = rows.join(errors, "subject_id", "left").join(ran, "subject_id", "left").join(evident.select(F.col("ref").alias("subject_id"), F.lit(True).alias("_seen")), "subject_id", "left")
    none, unnamed = F.array().cast("array<string>"), F.col("executive_name").isNull()
    subjects = rows.select(
        "subject_id", "executive_name", "company", "email", "url", (~unnamed & F.coalesce("_seen", F.lit(False))).alias("has_observations"),
        F.when(unnamed, none).otherwise(F.coalesce("_ran", none)).alias("providers"), F.when(unnamed, F.array(F.lit(NO_NAME))).otherwise(F.coalesce("_errors", none)).alias("errors"),
    )
    reports = evaluation.rows(subjects, observations, comparison.summaries(compared), events, verified)
    reports = reports.join(outcomes.select(F.col("ref").alias("subject_id"), F.col("decision").alias("identity")), "subject_id", "left")
    reports = reports.join(messages.select(F.col("ref").alias("subject_id"), "message"), "subject_id", "left")

    fresh = known.select(F.col(ref).alias("subject_id"), *[v.alias(f) for f, v in values.items()], _own(records, "duns_number").alias("duns_number"), _own(records, "url").alias("url"))
    table = stored.unionByName(storage.baseline_insert(stored, fresh, now))
    after = storage.apply_changes(table, compared, inflection.strongest(events), judged.select("ref"), now)
    return Run(reports, outcomes, compared, events, messages, after)


def process_landed(records: DataFrame, ref: str, seq: str, registry: DataFrame, landed: evidence.Landed, stored: DataFrame, now: Column, *, coordination: providers.CoordinationProfile | None = None, history: DataFrame | None = None, health: DataFrame | None = None, failures: DataFrame | None = None, **others) -> tuple[Run, evidence.Evidence]:
    """A whole run from what fetchers landed: which providers ran, what they saw, what broke, and then `process`.

    seq: the records' order in the run, a unique long.  failures: of stages outside this run, told with its own.  The
    reports also have pages_fetched and results_seen."""
    named = records.where(comparison.resolved(records)["name"].isNotNull())
    found = evidence.collect(named.select(F.col(ref).alias("subject_id"), F.col(seq).cast("long").alias("seq"), _own(records, "url").alias("url")), registry, landed, now, coordination, history, health)
    found = replace(found, observations=checkpointed(found.observations), failures=checkpointed(found.failures))
    broke = found.failures if failures is None else found.failures.unionByName(failures)
    run = process(records, ref, found.observations, stored, now, executed=found.executed, failures=broke, **others)
    reports = run.reports.join(found.seen, "subject_id", "left").na.fill(0, ["pages_fetched", "results_seen"])
    return replace(run, reports=reports), found


def first(records: DataFrame, seq: str, n: int) -> DataFrame:
    """The first n records of a run, by their order."""
    return records.orderBy(seq).limit(n)


def _own(records: DataFrame, name: str) -> Column:
    return F.col(name) if name in records.columns else F.lit(None).cast("string")


def summary(run: Run, observations: DataFrame) -> DataFrame:
    """The figures of a run, as one row: subjects by outcome, evidence, identities, inflections, changes, rates."""
    share = lambda part, of: F.when(of > 0, part / of * 100).otherwise(F.lit(0.0))
    counts = evaluation.batch_statistics(run.reports)
    seen = run.reports.agg(F.count_if(~F.col("inflections_detected").isin("none", "not_detected")).alias("subjects_with_inflections"), F.count("message").alias("messages"), *[F.count_if(F.col("identity") == d).alias(d) for d in ("auto_merge", "candidate_review", "new_identity")])
    parts = [counts, seen, run.events.agg(F.count("*").alias("inflections")), observations.agg(F.count("*").alias("observations"), F.countDistinct("subject_id").alias("subjects_with_evidence")), run.stored.agg(F.coalesce(F.sum("fields_updated"), F.lit(0)).cast("long").alias("fields_updated"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True))  # one row each
    return out.withColumns({"success_rate": share(F.col("success"), F.col("subjects")), "inflection_rate": share(F.col("subjects_with_inflections"), F.col("subjects")), "merge_rate": share(F.col("auto_merge"), F.col("auto_merge") + F.col("candidate_review") + F.col("new_identity"))})
