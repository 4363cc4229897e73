"""What a fetcher would have landed: search payloads and robots rules, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import urls as U

ITEMS = "items array<struct<title:string,link:string,snippet:string,displayLink:string,pagemap:struct<metatags:array<map<string,string>>>>>"
#: Under which name robots rules are looked up.
AGENT = "dossier"
# Meta tags that may say when a result was published, first of all the first.
DATE_TAGS = ("article:published_time", "og:article:published_time", "datepublished", "date", "og:updated_time")


def search_items(payloads: DataFrame, *keep: str) -> DataFrame:
    """payloads (subject_id, query, payload) as results: title, url, snippet, domain, published_at, rank; items without
    title or link go.  keep: more columns of the payloads, each of which has ranks of its own."""
    item = F.posexplode(F.from_json("payload", ITEMS)["items"]).alias("k", "i")
    rows = payloads.select("subject_id", "query", *keep, item)
    tags = F.try_element_at(F.col("i.pagemap.metatags"), F.lit(1))
    date = F.coalesce(*[F.when(F.trim(tags[t]) != "", F.trim(tags[t])) for t in DATE_TAGS])
    out = rows.where("i.title <> '' and i.link <> ''")
    return out.select("subject_id", "query", *keep, F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.coalesce("i.snippet", F.lit("")).alias("snippet"), F.coalesce("i.displayLink", U.part(F.col("i.link"), 2)).alias("domain"), date.alias("published_at"), (F.row_number().over(Window.partitionBy("subject_id", "query", *keep).orderBy("k"))).alias("rank"))


def _comparable(path: Column) -> Column:
    """The form in which a rule and a path are held against each other, however either is encoded."""
    return F.regexp_replace(U.unquoted(path), r"\?$", "")


def robots_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """robots.txt files (host, http_status, body) as rules host, position, prefix, allow for an agent.

    Lines are taken in order: agent lines that follow each other open a group, an empty line closes it, and
    the rest of a line after # does not count.  Prefixes are unquoted, as `allowed` does with paths.  The first group that names the agent holds, else the first
    one for all (*).  A missing file, and one without such a group, has no rules; so has an empty Disallow."""
    line = F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n")).alias("position", "raw")
    rows = files.where("http_status < 400").select(F.lower("host").alias("host"), line)
    rows = rows.withColumn("text", F.trim(F.regexp_replace("raw", "#.*$", ""), F.lit(" \t")))
    rows = rows.withColumns({"word": F.lower(F.trim(F.regexp_extract("text", r"^([^:]*):", 1))), "value": _comparable(F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1)))})
    kind = F.when(F.col("raw") == "", "end").when(F.col("word") == "user-agent", "agent").when(F.col("word").isin("allow", "disallow"), "rule").when(F.col("word").isin("crawl-delay", "request-rate"), "other")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    run = Window.partitionBy("host").orderBy("position")
    opens = (F.col("kind") == "agent") & ~F.lag("kind").over(run).eqNullSafe("agent")
    rows = rows.withColumns({"group": F.sum(opens.cast("int")).over(run), "closed": F.sum((F.col("kind") == "end").cast("int")).over(run)})
    # A group's lines have its number and as many empty lines before them.
    rules = F.array_sort(F.collect_list(F.when(F.col("kind") == "rule", F.struct("position", F.col("value").alias("prefix"), ((F.col("word") == "allow") | (F.col("value") == "")).alias("allow")))))
    groups = rows.groupBy("host", "group", "closed").agg(F.collect_set(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"), rules.alias("rules"))
    own = F.lit(agent.split("/")[0].lower())
    named = F.exists("agents", lambda a: (a != "*") & own.contains(a)) & ~F.array_contains("agents", "*")
    place = F.when(named, 0).when(F.array_contains("agents", "*"), 1)
    held = groups.withColumn("place", place).where("place is not null").groupBy("host").agg(F.min_by("rules", F.struct("place", "group")).alias("rules"))
    return held.select("host", F.explode("rules").alias("r")).select("host", "r.*")


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with `allowed`: what the first rule for its path (with its query) says; no rule: yes.  Rules are a
    few lines a host."""
    path = F.regexp_extract(F.col("url"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    keyed = pages.withColumns({"_host": F.lower(U.part(F.col("url"), 2)), "_path": _comparable(F.when(path == "", "/").otherwise(path))})
    by_host = rules.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_list(F.struct("position", "prefix", "allow"))).alias("_rules"))
    out = keyed.join(by_host, "_host", "left")
    first = F.get(F.filter("_rules", lambda r: (r["prefix"] == "*") | F.col("_path").startswith(r["prefix"])), F.lit(0))
    return out.select(*pages.columns, F.coalesce(first["allow"], F.lit(True)).alias("allowed"))


def fetchable(pages: DataFrame, rules: DataFrame, content_type: Column | None = None) -> DataFrame:
    """Pages that robots rules allow and that are no PDF."""
    return allowed(pages, rules).where(F.col("allowed") & ~U.is_pdf(F.col("url"), content_type)).drop("allowed")
