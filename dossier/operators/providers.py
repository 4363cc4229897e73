"""Provider coordination as data: who runs, why one is skipped, health, query templates, roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X
from dossier.operators.rules import ConfigurationError

UNHEALTHY, MAX_AGE_DAYS = 3, 30


def register(providers: DataFrame) -> DataFrame:
    """providers with unique ids, or an error before anything runs.  A registry has a few dozen rows."""
    twice = providers.groupBy("provider_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ConfigurationError(f"provider {twice[0]['provider_id']} is registered twice")
    return providers


def ordered(providers: DataFrame, subject_type: str) -> DataFrame:
    """Providers of a subject type with their place in (priority, provider_id) order."""
    own = providers.where(F.array_contains("subject_types", subject_type))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(subject_type)).orderBy("priority", "provider_id")))


@dataclass(frozen=True)
class CoordinationProfile:
    """How providers run: enabled, timeout_seconds, max_age_days, fallback_only by provider, else the defaults."""

    name: str = "default"
    providers: dict[str, dict] = field(default_factory=dict)
    defaults: dict = field(default_factory=lambda: {"enabled": True, "timeout_seconds": 10.0, "max_age_days": MAX_AGE_DAYS, "fallback_only": False})

    def validate(self) -> None:
        """Before any provider runs: a broken profile fails the whole run."""
        for own in (*self.providers.values(), self.defaults):
            of = self.defaults | own
            if of["timeout_seconds"] <= 0:
                raise ConfigurationError(f"profile {self.name}: a timeout of {of['timeout_seconds']} seconds")
            if of["max_age_days"] < 0:
                raise ConfigurationError(f"profile {self.name}: a greatest age of {of['max_age_days']} days")

    def apply(self, providers: DataFrame) -> DataFrame:
        """providers (provider_id) with their configuration.  Literal maps: a profile names some dozens."""
        self.validate()

        def column(k: str) -> Column:
            table = {p: own[k] for p, own in self.providers.items() if k in own}
            return (X.lookup(F.col("provider_id"), table, F.lit(self.defaults[k])) if table else F.lit(self.defaults[k])).alias(k)

        return providers.select("*", *map(column, self.defaults))


def configured(providers: DataFrame, configuration: DataFrame) -> DataFrame:
    """Left join with defaults: enabled, 30 days, no fallback."""
    out = providers.join(configuration, "provider_id", "left")
    return out.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "max_age_days": F.coalesce("max_age_days", F.lit(MAX_AGE_DAYS)), "fallback_only": F.coalesce("fallback_only", F.lit(False))})


def stale(now: Column, last: Column, days: Column) -> Column:
    """Never run, or at least `days` ago (inclusive)."""
    return last.isNull() | (now >= last + F.make_dt_interval(days))


def fresh(now: Column, cached_at: Column, seconds: int) -> Column:
    """A cache entry counts while it is younger than its lifetime."""
    return now < cached_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def skips(attempts: DataFrame, now: Column) -> DataFrame:
    """attempts (subject_id, provider_id, place, enabled, health, last_run, max_age_days, fallback_only, results)
    plus skip: disabled, unhealthy, not_stale, fallback_not_needed or null (it runs)."""
    base = F.when(~F.col("enabled"), "disabled").when(F.col("health") == "unhealthy", "unhealthy").when(~stale(now, F.col("last_run"), F.col("max_age_days")), "not_stale")
    out = attempts.withColumn("_skip", base)
    before = Window.partitionBy("subject_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # A skipped fallback had results before it, so counting its own would change nothing.
    earlier = F.coalesce(F.sum(F.when(F.col("_skip").isNull(), F.col("results")).otherwise(0)).over(before), F.lit(0))
    return out.withColumn("skip", F.coalesce("_skip", F.when(F.col("fallback_only") & (earlier > 0), "fallback_not_needed"))).drop("_skip")


def health(attempts: DataFrame, threshold: int = UNHEALTHY) -> DataFrame:
    """attempts (provider_id, seq, ok) plus consecutive_failures and status after each: a fold as gaps and islands."""
    run = Window.partitionBy("provider_id").orderBy("seq")
    out = attempts.withColumn("_island", F.sum(F.col("ok").cast("int")).over(run))
    inside = Window.partitionBy("provider_id", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("consecutive_failures", F.sum((~F.col("ok")).cast("int")).over(inside)).drop("_island")
    return out.withColumn("status", F.when(F.col("consecutive_failures") >= threshold, "unhealthy").when(F.col("consecutive_failures") > 0, "degraded").otherwise("healthy"))


def final_health(attempts: DataFrame, threshold: int = UNHEALTHY) -> DataFrame:
    """One row a provider: state after its last attempt, last success and failure."""
    h = health(attempts, threshold)
    return h.groupBy("provider_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("consecutive_failures", "seq").cast("long").alias("consecutive_failures"),
        F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("seq"))).alias("last_failure"),
    )


def replay(attempts: DataFrame, threshold: int = UNHEALTHY) -> DataFrame:
    """attempts plus ran: an unhealthy provider is skipped for good, so nothing runs after its first full streak."""
    h = health(attempts, threshold)
    dead = F.min(F.when(F.col("status") == "unhealthy", F.col("seq"))).over(Window.partitionBy("provider_id"))
    return h.withColumn("ran", dead.isNull() | (F.col("seq") <= dead)).drop("status", "consecutive_failures")


def without_policy_failures(attempts: DataFrame, error: str = "error", marker: str = "network policy") -> DataFrame:
    """Attempts that count for health where the network itself is closed: failures that say so do not."""
    return attempts.where(~(~F.col("ok") & F.coalesce(F.lower(F.col(error)).contains(marker), F.lit(False))))


def coordination_metrics(attempts: DataFrame) -> DataFrame:
    """Per subject: providers considered, executed, succeeded, failed, skipped, results collected."""
    ran = F.col("skip").isNull()
    return attempts.groupBy("subject_id").agg(
        F.count("*").alias("considered"), F.count_if(ran).alias("executed"), F.count_if(ran & F.col("ok")).alias("succeeded"),
        F.count_if(ran & ~F.col("ok")).alias("failed"), F.count_if(~ran).alias("skipped"), F.coalesce(F.sum(F.when(ran, F.col("results"))), F.lit(0)).alias("collected"),
    )


def queries(subjects: DataFrame, provider: str) -> DataFrame:
    """subject_id, position, query: the provider's templates filled in.

    subjects: subject_id, name, company, title.  A template whose value is blank, or that names another
    place, is left out; equal queries count once."""
    # A subject's queries are made and told apart in its row: the shuffle, if any, carries subjects, not their queries.
    values = [X.strip(F.coalesce(F.col(p), F.lit(""))).alias(p) for p in _FILLED]
    return _apart(subjects.groupBy("subject_id").agg(F.collect_set(F.struct(*values)).alias("_v")), provider, "subject_id")


def _apart(own: DataFrame, provider: str, key: str) -> DataFrame:
    """key, query, position: the queries of each row's values `_v`, equal ones once."""
    out = own.select(key, F.sort_array(F.flatten(F.transform("_v", lambda v: _made(v, provider)))).alias("_m"))
    out = out.withColumn("_t", F.transform("_m", lambda x: x["query"]))
    return out.select(key, F.explode(F.filter("_m", lambda x, k: F.array_position("_t", x["query"]) == k + 1)).alias("x")).select(key, "x.query", "x.position")


def request_counts(subjects: DataFrame) -> DataFrame:
    """provider, site, sent, cache_key, subjects: how many subjects (a row each) share a request.

    Subjects whose values are equal are counted before their queries are made."""
    values = [X.strip(F.coalesce(F.col(p), F.lit(""))).alias(p) for p in _FILLED]
    alike = subjects.groupBy(*values).agg(F.count("*").alias("_n")).select("_n", F.array(F.struct(*_FILLED)).alias("_v"))
    made = [requests(_apart(alike, p, "_n"), p).withColumn("provider", F.lit(p)) for p in R.QUERY_TEMPLATES]
    return reduce(DataFrame.unionByName, made).groupBy("provider", "site", "sent", "cache_key").agg(F.sum("_n").alias("subjects"))


_FILLED = ("name", "company", "title")


def _made(values: Column, provider: str) -> Column:
    """The provider's queries (position, query) of stripped values; a template that cannot be used gives none."""
    rows = []
    for k, template in enumerate(R.QUERY_TEMPLATES[provider]):
        query, usable = F.lit(template), F.lit(True)
        for p in _FILLED:
            if "{" + p + "}" in template:
                query, usable = F.replace(query, F.lit("{" + p + "}"), values[p]), usable & (values[p] != "")
        rows.append(F.when(usable, F.struct(F.lit(k).alias("position"), X.strip(query).alias("query"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull() & (x["query"] != ""))


def site_clause(domains: tuple[str, ...] = R.NEWS_DOMAINS) -> str:
    return "(" + " OR ".join(f"site:{d}" for d in domains) + ")"


def requests(made: DataFrame, provider: str) -> DataFrame:
    """Queries of a provider as they are sent: plus sent (the text), site (the one domain asked for, or null) and cache_key.

    Several domains go into the text as a clause, one goes beside it; equal requests of all subjects share a cache entry."""
    sent = F.concat_ws(" ", F.lit(site_clause()), "query") if provider == "news_search" else F.col("query")
    site = F.lit(R.SITES.get(provider)).cast("string")
    return made.withColumns({"sent": sent, "site": site, "cache_key": F.concat(F.coalesce(site, F.lit("")), F.lit("::"), sent)})


def query_status(ok: Column, all_: Column) -> Column:
    """Of a provider's queries: none ok is failure, some partial, all success."""
    return F.when(ok == 0, "failure").when(ok < all_, "partial").otherwise("success")


def site_status(pages: DataFrame) -> DataFrame:
    """subject_id, status: any page that failed makes it partial; one that robots rules forbid does not."""
    failed = F.count_if(F.col("outcome") == "failed")
    return pages.groupBy("subject_id").agg(F.when(failed > 0, "partial").otherwise("success").alias("status"))


def verification(responses: DataFrame) -> DataFrame:
    """responses (subject_id, email, http_status, body) plus status, retryable, technical_failure, masked."""
    body = F.from_json("body", "status string, result string")
    verdict = X.lookup(body["result"], R.EMAIL_VERDICTS, F.lit("unknown"))
    http = F.col("http_status")
    status = F.when(http == 429, "rate_limited").when(http == 408, "timeout").when(http >= 400, "error").when(body["status"] == "success", verdict).otherwise(X.lookup(body["status"], R.RETRYABLE_VERDICTS, F.lit("error")))
    retry = (http >= 500) | (http == 429) | body["status"].isin(*R.RETRYABLE_VERDICTS)
    return responses.withColumns({"status": status, "retryable": F.coalesce(retry, F.lit(False)), "technical_failure": status.isin(*R.TECHNICAL_FAILURES), "masked": mask(F.col("email"))})


def mask(email: Column) -> Column:
    """First letter, three stars, domain."""
    return F.when(email.contains("@"), F.concat(F.substring(email, 1, 1), F.lit("***@"), F.substring_index(email, "@", -1))).otherwise(F.lit("***"))


def known_attributes(df: DataFrame) -> Column:
    """Map of the five known attributes, stripped, blanks left out."""
    pairs = {"first_name": "first_name", "last_name": "last_name", "title": "title", "company_name": "company_name", "email": "email"}
    entries = [x for k, c in pairs.items() if c in df.columns for x in (F.lit(k), X.strip(F.col(c)))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull() & (v != ""))


def fetch_outcome(http_status: Column) -> Column:
    """2xx ok, 5xx (or none) worth a retry, anything else final."""
    return F.when(http_status.between(200, 299), "ok").when(http_status.isNull() | (http_status >= 500), "retry").otherwise("failed")
