"""Facts from page text, and pages as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import html as H
from dossier.functions import text as X


def _clean(c: Column) -> Column:
    out = F.regexp_replace(X.strip(c), "^,+|,+$", "")
    return F.when(out != "", out)


def fact(title: Column, text: Column) -> Column:
    """struct<full_name, title, company_name, pattern> of the first pattern that matches, the title before the text; null: none."""
    tries = []
    for source in (title, text):
        for name, pattern, groups in R.FACTS:
            full = "(?U)" + pattern
            get = lambda g: _clean(F.regexp_extract(source, full, groups.index(g) + 1)) if g in groups else F.lit(None).cast("string")  # noqa: B023, E731
            tries.append(F.when(source.rlike(full), F.struct(get("n").alias("full_name"), get("r").alias("title"), get("c").alias("company_name"), F.lit(name).alias("pattern"))))
    return F.coalesce(*tries)


def _first(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 0)
    return F.when(found != "", found)


def email(c: Column) -> Column:
    return _first(c, "(?U)" + R.EMAIL_SHAPE)


def phone(c: Column) -> Column:
    return X.strip(_first(c, "(?U)" + R.PHONE_SHAPE))


def profile_url(c: Column) -> Column:
    return _first(c, R.PROFILE_SHAPE)


def event_keywords(c: Column) -> Column:
    """Labels of the event words in a text, comma and blank between, in table order; null: none."""
    found = F.filter(F.array(*[F.when(c.rlike("(?iU)" + p), F.lit(label)) for label, p in R.EVENTS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def facts(pages: DataFrame, title: str, text: str) -> DataFrame:
    """pages plus fact (struct) and email, phone, profile_url, event_keywords."""
    t, x = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns({"fact": fact(t, x), "email": email(x), "phone": phone(x), "profile_url": profile_url(x), "event_keywords": event_keywords(F.concat(t, F.lit(" "), x))})


def page_facts(pages: DataFrame) -> DataFrame:
    """What observations need of pages' parsed content `c`, in its place: page_title, page_excerpt, published_at and the
    columns of `facts`."""
    found = facts(pages.withColumns({"page_title": F.col("c.title"), "page_text": F.col("c.text"), "published_at": F.col("c.published_at")}), "page_title", "page_text")
    return found.withColumn("page_excerpt", F.substring("page_text", 1, H.MAX_EXCERPT)).drop("c", "page_text")


def observations(results: DataFrame, pages: DataFrame, read: bool = False) -> DataFrame:
    """Up to nine observations a result: always web_page, then the facts found, all with the same context.

    results: subject_id, url, title, snippet, source, rank, confidence.  pages: url, html; with `read`: url and the
    columns of `page_facts`."""
    found = results.join(pages, "url") if read else page_facts(results.join(pages.select("url", H.page_content(F.col("html")).alias("c")), "url"))
    excerpt = F.col("page_excerpt")
    context = F.map_filter(
        F.create_map(*[x for k, v in {
            "search_source": F.col("source"), "search_rank": F.col("rank").cast("string"), "search_result_title": F.col("title"), "snippet": F.col("snippet"),
            "page_title": F.col("page_title"), "text_excerpt": excerpt, "published_at": F.when(F.col("published_at") != "", F.col("published_at")), "matched_pattern": F.col("fact")["pattern"],
        }.items() for x in (F.lit(k), v)]),
        lambda k, v: v.isNotNull(),
    )
    values = [("web_page", F.coalesce(F.when(F.col("page_title") != "", F.col("page_title")), F.col("title"))), ("full_name", F.col("fact")["full_name"]), ("title", F.col("fact")["title"]), ("company_name", F.col("fact")["company_name"]), ("email", F.col("email")), ("phone", F.col("phone")), ("linkedin_url", F.col("profile_url")), ("published_at", F.col("published_at")), ("event_keywords", F.col("event_keywords"))]
    rows = [F.struct(F.lit(k).alias("position"), F.lit(a).alias("attribute"), v.alias("value")) for k, (a, v) in enumerate(values)]
    kind = X.lookup(F.col("source"), R.EVIDENCE_TYPES, F.lit("web_mention"))
    out = found.select("subject_id", F.col("url").alias("source_url"), F.col("source").alias("source_provider"), "confidence", F.col("published_at").alias("published_date"), excerpt.alias("raw_text"), kind.alias("evidence_type"), context.alias("raw_context"), F.explode(F.array(*rows)).alias("x"))
    return out.select("subject_id", F.lit("search_extraction").alias("provider_id"), "x.position", "x.attribute", "x.value", "source_url", "source_provider", "confidence", "published_date", "raw_text", "evidence_type", "raw_context").where("attribute = 'web_page' or (value is not null and value <> '')")


def person_observations(pages: DataFrame) -> DataFrame:
    """People on company pages (subject_id, url, html) as observations that share a person_ref."""
    people = H.page_people(pages.select("subject_id", "url", "html"))
    fields = [("full_name", "name"), ("title", "title"), ("biography", "bio"), ("email", "email"), ("phone", "phone")]
    rows = [F.struct(F.lit(k).alias("position"), F.lit(a).alias("attribute"), F.col(f"p.{c}").alias("value")) for k, (a, c) in enumerate(fields)] + [F.struct(F.lit(5).alias("position"), F.lit("source_page").alias("attribute"), F.col("url").alias("value"))]
    ref = F.sha2(F.concat_ws("|", "url", F.col("nth").cast("string"), "p.name"), 256)
    return people.select("subject_id", F.lit("company_website").alias("provider_id"), ref.alias("person_ref"), F.explode(F.array(*rows)).alias("x")).select("subject_id", "provider_id", "person_ref", "x.*").where("value is not null and value <> ''")


def mention_observations(results: DataFrame) -> DataFrame:
    """Web-search results as web_mention observations.  results: subject_id, query, title, url, snippet, domain, published_at."""
    pairs = [("query", "query"), ("snippet", "snippet"), ("domain", "domain"), ("published_at", "published_at")]
    context = F.map_filter(F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    return results.select("subject_id", F.lit("google_search").alias("provider_id"), F.lit("web_mention").alias("attribute"), F.col("title").alias("value"), F.col("url").alias("source_url"), context.alias("raw_context"))
