"""A run's evidence out of landed tables: which provider ran for which subject, and what it saw.

Stages of a subject: enrichment as a person, enrichment as a company, search, extraction of the results.
Within a stage providers go by priority.  One is skipped where its profile has it off, where its breaker
is open, where its last run is not yet stale, or, a fallback, where providers before it had results; only
the rows of a provider that ran are read.

The breaker couples subjects: after THRESHOLD failures in a row, in the order of the run, a provider is
left alone.  Whether an attempt takes place is so a question about all attempts before it.  Its answer is
one number for each provider, the place of the attempt that opens its breaker, and `first_break` finds it
without putting a provider's attempts in order in one task.  A fallback's attempts depend on who ran
before it, so fallbacks are settled one after another over one small table, a row a subject.

What a stage cannot read is data too: a request that failed, or an answer that is no JSON, fails the
provider for that subject; a page that cannot be parsed fails the subject's extraction, and no other's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import html as H
from dossier.functions import urls as U
from dossier.functions.cut import checkpointed
from dossier.operators import extraction, providers, search
from dossier.sources import landed as L

PERSON, COMPANY, SEARCH = "person", "company", "search"
PHASES = (PERSON, COMPANY, SEARCH)
THRESHOLD, BUCKETS = providers.UNHEALTHY, 1024
#: The providers whose landed tables are not payloads of results: pages of the subject's own site.
WEBSITE, MENTIONS = "company_website", "google_search"
NOTHING = "Nothing was landed."
UNREADABLE = "The answer is no JSON."


@dataclass(frozen=True)
class Landed:
    """What fetchers left behind.

    payloads: subject_id, provider_id, query, payload (JSON of items), error (what the request raised, or null).
    sites: subject_id, url, html, error: pages of a subject's own site.  pages: url, html: what results point to."""

    payloads: DataFrame
    sites: DataFrame
    pages: DataFrame


@dataclass(frozen=True)
class Evidence:
    """attempts: subject_id, phase, place, provider_id, skip (null: it ran), status, results, error.
    executed: subject_id, provider_id, place.  observations: subject_id, provider_id, attribute, value, source_url.
    failures: subject_id, stage, error.  seen: subject_id, pages_fetched, results_seen."""

    attempts: DataFrame
    executed: DataFrame
    observations: DataFrame
    failures: DataFrame
    seen: DataFrame


@dataclass(frozen=True)
class _Slot:
    """A provider's place in a stage, with its configuration."""

    phase: str
    place: int
    provider: str
    enabled: bool
    max_age_days: int
    fallback: bool

    @property
    def tracker(self) -> str:
        """Enrichment and search each keep their own breakers."""
        return f"{SEARCH if self.phase == SEARCH else 'enrichment'}/{self.provider}"


def first_break(attempts: DataFrame, threshold: int = THRESHOLD, before: dict[str, int] | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """For each key the place `at` of the first attempt that completes `threshold` failures in a row, if any.

    attempts: key (a few dozen values), at (a long, unique within a key), ok.  before: failures in a row with which a
    key begins.  Attempts are cut into ranges of `at`; a range knows its streaks, the failures at its two ends, and
    whether it held a success; the ends of neighbours are put together in a table of a row a key and range."""
    ends = attempts.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    if ends["a"] is None:
        return {}
    width = (ends["b"] - ends["a"]) // buckets + 1
    rows = attempts.withColumn("b", F.expr(f"(at - {ends['a']}) div {width}"))
    run = Window.partitionBy("key", "b").orderBy("at")
    rows = rows.withColumn("island", F.sum(F.col("ok").cast("int")).over(run))
    rows = rows.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "b", "island").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    first = (F.col("island") == 0) & (F.col("streak") <= threshold)
    ranges = rows.groupBy("key", "b").agg(
        F.max("island").alias("oks"),
        F.max_by("streak", "at").alias("last"),
        F.max(F.when(F.col("island") == 0, F.col("streak"))).alias("lead"),
        F.array_sort(F.collect_list(F.when(first, F.col("at")))).alias("places"),  # `threshold` at most
        F.min(F.when((F.col("island") > 0) & (F.col("streak") >= threshold), F.col("at"))).alias("inner"),
    )
    start = F.coalesce(*[F.when(F.col("key") == k, F.lit(n)) for k, n in (before or {}).items()], F.lit(0))
    by_key = Window.partitionBy("key").orderBy("b")
    ranges = ranges.withColumn("part", F.sum((F.col("oks") > 0).cast("int")).over(by_key))  # opened by the last range with a success
    ranges = ranges.withColumn("open", F.sum("last").over(Window.partitionBy("key", "part").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("part") == 0, start).otherwise(0))
    carried = F.coalesce(F.lag("open").over(by_key), start)
    ranges = ranges.withColumn("carried", carried)
    reached = F.when(F.coalesce("lead", F.lit(0)) + F.col("carried") >= threshold, F.try_element_at("places", F.greatest(F.lit(1), F.lit(threshold) - F.col("carried")).cast("int")))
    found = ranges.groupBy("key").agg(F.min(F.least(reached, F.col("inner"))).alias("at")).where("at is not null")
    return {r["key"]: r["at"] for r in found.collect()}  # one number a key


def answers(landed: Landed) -> DataFrame:
    """subject_id, provider_id, status, results, error: what each provider's landed rows amount to for a subject."""
    p = readable(landed.payloads)
    items = F.coalesce(F.size(F.filter(F.from_json("payload", L.ITEMS)["items"], lambda i: (i["title"] != "") & (i["link"] != ""))), F.lit(0))
    rows = p.select("subject_id", "provider_id", "query", "failed", F.when(F.col("failed").isNull(), items).otherwise(0).alias("n"))
    s = landed.sites.select("subject_id", F.lit(WEBSITE).alias("provider_id"), F.col("url").alias("query"), F.col("error").alias("failed"), F.when(F.col("error").isNull(), 1).otherwise(0).alias("n"))
    ok = F.count_if(F.col("failed").isNull())
    return rows.unionByName(s).groupBy("subject_id", "provider_id").agg(providers.query_status(ok, F.count("*")).alias("status"), F.sum("n").alias("results"), F.min_by("failed", F.when(F.col("failed").isNotNull(), F.col("query"))).alias("error"))


def readable(payloads: DataFrame) -> DataFrame:
    """payloads plus failed: why a payload cannot be read; null: it can."""
    return payloads.withColumn("failed", F.coalesce("error", F.when(F.try_parse_json("payload").isNull(), F.lit(UNREADABLE))))


def _slots(registry: DataFrame, profile: providers.CoordinationProfile) -> list[_Slot]:
    """A registry has a few dozen rows."""
    rows = profile.apply(providers.register(registry)).collect()
    out = []
    for phase in PHASES:
        own = sorted((r for r in rows if phase in r["phases"]), key=lambda r: (r["priority"], r["provider_id"]))
        out += [_Slot(phase, k + 1, r["provider_id"], r["enabled"], r["max_age_days"], phase == SEARCH and r["fallback_only"]) for k, r in enumerate(own)]
    return out


def coordinate(subjects: DataFrame, registry: DataFrame, profile: providers.CoordinationProfile, answered: DataFrame, now: Column, history: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """The attempts of a run: a row a subject, stage and provider.

    subjects: subject_id, seq (their order in the run: a unique long).  registry: provider_id, phases (of person,
    company, search), priority.  answered: as `answers` gives it.  history: subject_id, provider_id, last_run.
    health: provider_id, consecutive_failures with which enrichment begins."""
    slots = _slots(registry, profile)
    names = sorted({s.provider for s in slots})
    schema = "subject_id string, seq long"
    if not slots:
        return subjects.sparkSession.createDataFrame([], f"{schema}, phase string, place int, provider_id string, skip string, status string, results long, error string").drop("seq")
    before = {f"enrichment/{r['provider_id']}": r["consecutive_failures"] for r in health.where(F.col("provider_id").isin(names)).collect()} if health is not None else {}
    told = answered.where(F.col("provider_id").isin(names)).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("provider_id", F.struct("status", "results", "error")))).alias("told"))
    base = subjects.select("subject_id", "seq").join(told, "subject_id", "left")
    if history is not None:
        last = history.where(F.col("provider_id").isin(names)).groupBy("subject_id", "provider_id").agg(F.max("last_run").alias("t")).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("provider_id", "t"))).alias("last"))
        base = base.join(last, "subject_id", "left")
    else:
        base = base.withColumn("last", F.lit(None).cast("map<string,timestamp>"))
    base = checkpointed(base)  # a row a subject; read once for the breakers and once for each fallback

    got = {p: F.col("told")[p] for p in names}
    well = {p: F.coalesce(got[p]["status"].isin("success", "partial"), F.lit(False)) for p in names}
    amount = {p: F.coalesce(got[p]["results"], F.lit(0)) for p in names}
    at = {s: F.col("seq") * 2 + int(s.phase == COMPANY) for s in slots}
    wants = {s: F.lit(s.enabled) & providers.stale(now, F.col("last")[s.provider], F.lit(s.max_age_days)) for s in slots}
    dead: dict[str, int] = {k: -(1 << 62) for k, n in before.items() if n >= THRESHOLD}

    def healthy(s: _Slot) -> Column:
        return at[s] <= dead[s.tracker] if s.tracker in dead else F.lit(True)

    def earlier(s: _Slot) -> Column:
        own = [F.when(wants[x] & healthy(x) & ~_unneeded(x), amount[x.provider]).otherwise(0) for x in slots if x.phase == SEARCH and x.place < s.place]
        return reduce(lambda a, b: a + b, own, F.lit(0))

    def _unneeded(s: _Slot) -> Column:
        return F.col(f"_late_{s.place}") if s.fallback else F.lit(False)

    def settle(of: list[_Slot], over: DataFrame) -> None:
        tried = [F.when(wants[s] & ~_unneeded(s) & F.lit(s.tracker not in dead), F.struct(F.lit(s.tracker).alias("key"), at[s].alias("at"), well[s.provider].alias("ok"))) for s in of]
        if tried:
            dead.update(first_break(over.select(F.explode(F.array(*tried)).alias("x")).where("x is not null").select("x.*"), THRESHOLD, before))

    settle([s for s in slots if not s.fallback], base)
    for s in (s for s in slots if s.fallback):
        base = base.withColumn(f"_late_{s.place}", earlier(s) > 0)
        settle([s], base)

    def attempt(s: _Slot) -> Column:
        skip = F.when(F.lit(not s.enabled), "disabled").when(~healthy(s), "unhealthy").when(~wants[s], "not_stale").when(_unneeded(s), "fallback_not_needed")
        error = F.when(got[s.provider].isNull(), F.lit(NOTHING)).otherwise(got[s.provider]["error"])
        ran = skip.isNull()
        return F.struct(
            F.lit(s.phase).alias("phase"), F.lit(s.place).alias("place"), F.lit(s.provider).alias("provider_id"), skip.alias("skip"),
            F.when(ran, F.coalesce(got[s.provider]["status"], F.lit("failure"))).alias("status"), F.when(ran, amount[s.provider]).otherwise(0).alias("results"), F.when(ran, error).alias("error"),
        )

    return base.select("subject_id", F.explode(F.array(*map(attempt, slots))).alias("x")).select("subject_id", "x.*")


def collect(subjects: DataFrame, registry: DataFrame, landed: Landed, now: Column, profile: providers.CoordinationProfile | None = None, history: DataFrame | None = None, health: DataFrame | None = None, pages: int = 8) -> Evidence:
    """The evidence of a run.  subjects: subject_id, seq, url (the subject's own site, or null).  pages: most pages of
    a site that are read."""
    attempts = checkpointed(coordinate(subjects, registry, profile or providers.CoordinationProfile(), answers(landed), now, history, health))
    ran = attempts.where("skip is null")
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")) * 1000 + F.col("place")
    executed = ran.select("subject_id", "provider_id", order.cast("int").alias("place"))

    # Results of the search stage, one for each URL of a subject, and what their pages say.
    read = readable(landed.payloads).where("failed is null").drop("failed", "error")
    searched = read.join(ran.where(F.col("phase") == SEARCH).select("subject_id", "provider_id", "place"), ["subject_id", "provider_id"])
    items = L.search_items(searched, "provider_id", "place").withColumnRenamed("provider_id", "source")
    found = items.withColumns({"confidence": search.confidence(F.col("url"), F.col("source")), "seq": F.struct("place", "query", "rank")})
    ranked = search.dedup_rank(found, ["subject_id"]).select("subject_id", "url", "title", "snippet", "source", F.col("position").alias("rank"), "confidence")
    ranked = checkpointed(ranked)  # read for the pages that it names, broken ones, observations and counts
    # A page is parsed once, whatever names it, and dealt over tasks before: a table's files may be few.
    named = landed.pages.select("url", "html").repartition("url").join(ranked.select("url").distinct(), "url", "left_semi")
    content = named.select("url", H.page_content_or_error(F.col("html")).alias("c")).withColumn("error", F.col("c.error"))
    pages_read = checkpointed(extraction.page_facts(content))
    hit = ranked.select("subject_id", "url").join(pages_read.where("error is not null").select("url", "error"), "url")
    broken = hit.groupBy("subject_id").agg(F.min_by("error", "url").alias("error"))
    good = ranked.join(broken, "subject_id", "left_anti")
    extracted = extraction.observations(good, pages_read.where("error is null").drop("error"), read=True)

    # Mentions and the subject's own site: enrichment, whatever the stage in which the provider ran.
    enriched = ran.where(F.col("phase") != SEARCH).select("subject_id", "provider_id").distinct()
    mentions = extraction.mention_observations(L.search_items(read.where(F.col("provider_id") == MENTIONS).join(enriched, ["subject_id", "provider_id"], "left_semi")))
    visited = site_pages(subjects.join(enriched.where(F.col("provider_id") == WEBSITE), "subject_id", "left_semi"), landed.sites.where("error is null"), pages)
    people = extraction.person_observations(visited)

    columns = ["subject_id", "provider_id", "attribute", "value", "source_url"]
    site = people.withColumn("source_url", F.lit(None).cast("string"))
    observations = reduce(DataFrame.unionByName, [x.select(*columns) for x in (extracted, mentions, site)])
    failures = broken.select("subject_id", F.lit("Search extraction").alias("stage"), "error")
    fetched = visited.groupBy("subject_id").agg(F.count("*").alias("pages_fetched"))
    results = ranked.groupBy("subject_id").agg(F.count("*").alias("results_seen"))
    seen = subjects.select("subject_id").join(fetched, "subject_id", "left").join(results, "subject_id", "left").na.fill(0, ["pages_fetched", "results_seen"])
    return Evidence(attempts, executed, observations, failures, seen)


def site_pages(subjects: DataFrame, sites: DataFrame, most: int = 8) -> DataFrame:
    """subject_id, url, html: the pages of each subject's site that a bounded crawl from its own URL visits.

    A crawl stays on its subject's pages, so those of other subjects are not parsed."""
    key = U.crawl_key(F.col("url"))
    own = sites.join(subjects.where("url is not null").select("subject_id"), "subject_id", "left_semi").groupBy("subject_id", key.alias("key")).agg(F.min_by(F.struct("url", "html"), "url").alias("p")).select("subject_id", "key", "p.url", "p.html")
    page = F.concat_ws("\n", "subject_id", "key").alias("page_id")
    links = search.priority_links(search.page_links(own.select(page, "url", "html"))).select(F.col("page_id").alias("url"), F.concat_ws("\n", F.substring_index("page_id", "\n", 1), "link").alias("link"), "score")
    seeds = subjects.where("url is not null").select(F.col("subject_id").alias("site"), F.concat_ws("\n", "subject_id", key).alias("url"))
    there = own.select("subject_id", "url", "html", page)
    visits = search.crawl(seeds, links, most, fetched=there.select(F.col("page_id").alias("url")))
    visits = checkpointed(visits.select(F.col("url").alias("page_id")))  # keys only; finding them parses all pages of a site
    return visits.join(there, "page_id").select("subject_id", "url", "html")
