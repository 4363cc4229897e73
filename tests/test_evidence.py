"""Runs from landed tables against a plain sequential run."""

import datetime
import json
import random
import uuid

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.functions import html as H
from dossier.operators import evidence, search, subjects
from dossier.operators.evidence import Landed
from dossier.operators.providers import CoordinationProfile
from dossier.plans import registry

NOW = datetime.datetime(2024, 6, 1)
BROKEN = "<![x[ "


def _simple_break(oks, threshold, streak):
    for at, ok in oks:
        streak = 0 if ok else streak + 1
        if streak >= threshold:
            return at
    return None


@pytest.mark.parametrize("seed", range(4))
def test_first_break_is_that_of_a_sequential_reading(spark, seed):
    r = random.Random(seed)
    rows, want, before = [], {}, {"a": 2, "b": 1, "e": 5}
    for key, p in zip("abcdefg", (0.3, 0.5, 0.05, 0.1, 0.2, 0.0, 1.0)):
        ats = sorted(r.sample(range(-50, 400), r.randint(1, 120)))
        oks = [(at, r.random() >= p) for at in ats]
        rows += [(key, at, ok) for at, ok in oks]
        if (at := _simple_break(oks, 3, before.get(key, 0))) is not None:
            want[key] = at
    df = spark.createDataFrame(rows, "key string, at long, ok boolean").repartition(3)
    for buckets in (1, 7, 1000):
        got = evidence.first_break(df, 3, before, buckets)
        assert {k: v for k, v in got.items() if k != "e"} == {k: v for k, v in want.items() if k != "e"}
    assert evidence.first_break(df.limit(0), 3) == {}


REGISTRY = [("site", ["person", "company"], 2), ("mention", ["person"], 1), ("one", ["search"], 1), ("two", ["search"], 2), ("three", ["search"], 3), ("off", ["search"], 0)]
PROFILE = CoordinationProfile(providers={"two": {"fallback_only": True}, "three": {"fallback_only": True}, "off": {"enabled": False}, "mention": {"max_age_days": 10}})


def _plain_run(people, told, last):
    """One subject after another, as a coordinator would."""
    streak, out = {("enrichment", "mention"): 1}, []
    for subject in people:
        for phase in ("person", "company", "search"):
            own = sorted((x for x in REGISTRY if phase in x[1]), key=lambda x: (x[2], x[0]))
            results = 0
            for place, (p, _, _) in enumerate(own, 1):
                of = PROFILE.defaults | PROFILE.providers.get(p, {})
                tracker = ("search" if phase == "search" else "enrichment", p)
                ran = last.get((subject, p))
                if not of["enabled"]:
                    skip = "disabled"
                elif streak.get(tracker, 0) >= 3:
                    skip = "unhealthy"
                elif ran is not None and NOW < ran + datetime.timedelta(days=of["max_age_days"]):
                    skip = "not_stale"
                elif phase == "search" and of["fallback_only"] and results:
                    skip = "fallback_not_needed"
                else:
                    skip = None
                if skip:
                    out.append((subject, phase, place, p, skip, None, 0, None))
                    continue
                status, n, error = told.get((subject, p), ("failure", 0, evidence.NOTHING))
                streak[tracker] = 0 if status != "failure" else streak.get(tracker, 0) + 1
                results += n
                out.append((subject, phase, place, p, None, status, n, error))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,failing", [(1, 0.15), (2, 0.45), (3, 0.02)])
def test_attempts_are_those_of_a_sequential_run(spark, seed, failing):
    r = random.Random(seed)
    people = [f"s{k}" for k in range(90)]
    told = {}
    for s in people:
        for p, *_ in REGISTRY:
            if r.random() < 0.97:
                bad = r.random() < failing
                told[s, p] = ("failure", 0, "no") if bad else (r.choice(["success", "partial"]), r.choice([0, 0, 1, 3]), None)
    last = {(s, p): NOW - datetime.timedelta(days=r.choice([5, 10, 29, 30, 31])) for s in people for p, *_ in REGISTRY if r.random() < 0.3}
    got = evidence.coordinate(
        spark.createDataFrame([(s, k * 3) for k, s in enumerate(people)], "subject_id string, seq long").repartition(3),
        spark.createDataFrame(REGISTRY, "provider_id string, phases array<string>, priority int"), PROFILE,
        spark.createDataFrame([(*k, *v) for k, v in told.items()] + [("s1", "unregistered", "success", 5, None)], "subject_id string, provider_id string, status string, results long, error string"), F.lit(NOW),
        spark.createDataFrame([(*k, v) for k, v in last.items()], "subject_id string, provider_id string, last_run timestamp"), spark.createDataFrame([("mention", 1), ("other", 9)], "provider_id string, consecutive_failures int"),
    )
    assert sorted((tuple(x) for x in got.collect()), key=str) == _plain_run(people, told, last)


def _payload(*links):
    return json.dumps({"items": [{"title": f"T {x}", "link": x, "snippet": "s"} for x in links]})


def test_only_rows_of_providers_that_ran_are_read_and_broken_pages_cost_their_subject_alone(spark):
    payloads = [
        ("a", "one", "q1", _payload("http://n.com/1"), None), ("a", "one", "q2", "no json", None), ("a", "two", "q", _payload("http://n.com/2"), None), ("b", "one", "q", _payload(), None),
        ("b", "two", "q", _payload("http://n.com/2", "http://n.com/broken"), None), ("c", "one", "q", None, "HTTP 500"), ("c", "two", "q", _payload("http://n.com/2", "http://n.com/2/", "http://n.com/gone"), None), ("a", "off", "q", _payload("http://n.com/3"), None),
        ("a", "google_search", "q", _payload("http://m.com"), None), ("b", "google_search", "q", "{", None),
    ]
    page = "<html><title>{}</title><body>{}</body></html>"
    pages = [("http://n.com/1", page.format("Jane Doe, Editor at Beta Inc.", "")), ("http://n.com/2", page.format("News", "Mail x@y.com now")), ("http://n.com/broken", BROKEN + "x"), ("http://n.com/3", page.format("x", "z@z.com"))]
    person = '<div class="team-member"><h2>Ann Lee</h2><p class="title">CEO</p></div>'
    sites = [("a", "http://a.com/", '<a href="/team">Our leadership</a><a href="/bad">Leadership team</a><a href="/far">far</a>', None), ("a", "http://a.com/team", person, None), ("a", "http://a.com/bad", BROKEN + person, None), ("a", "http://a.com/far", person.replace("Ann", "Eve"), None), ("b", "http://b.com", None, "HTTP 404")]
    landed = Landed(spark.createDataFrame(payloads, "subject_id string, provider_id string, query string, payload string, error string"), spark.createDataFrame(sites, "subject_id string, url string, html string, error string"), spark.createDataFrame(pages, "url string, html string"))
    own = [("company_website", ["company"], 1), ("google_search", ["person"], 1), ("one", ["search"], 1), ("two", ["search"], 2), ("off", ["search"], 3)]
    found = evidence.collect(spark.createDataFrame([("a", 1, "http://a.com"), ("b", 2, "http://b.com"), ("c", 3, None)], "subject_id string, seq long, url string"), spark.createDataFrame(own, "provider_id string, phases array<string>, priority int"), landed, F.lit(NOW), CoordinationProfile(providers={"two": {"fallback_only": True}, "off": {"enabled": False}}))
    status = {(x["subject_id"], x["provider_id"]): (x["skip"], x["status"], x["error"]) for x in found.attempts.collect()}
    assert status["a", "one"] == (None, "partial", evidence.UNREADABLE) and status["a", "two"] == ("fallback_not_needed", None, None) and status["c", "one"] == (None, "failure", "HTTP 500")
    assert status["b", "google_search"] == (None, "failure", evidence.UNREADABLE) and status["c", "google_search"] == (None, "failure", evidence.NOTHING) and status["b", "company_website"] == (None, "failure", "HTTP 404")
    seen = sorted((x["subject_id"], x["provider_id"], x["attribute"], x["value"]) for x in found.observations.collect())
    assert ("a", "search_extraction", "full_name", "Jane Doe") in seen and ("c", "search_extraction", "email", "x@y.com") in seen and ("a", "google_search", "web_mention", "T http://m.com") in seen
    assert not any(v in ("x@y.com", "z@z.com") for s, _, _, v in seen if s in "ab") and not any(v == "Eve Lee" for *_, v in seen)
    assert [v for s, p, a, v in seen if p == "company_website"] == ["Ann Lee", "http://a.com/team", "CEO"]
    assert [tuple(x) for x in found.failures.collect()] == [("b", "Search extraction", "unknown status keyword 'x' in marked section")]
    assert sorted(tuple(x) for x in found.seen.collect()) == [("a", 3, 1), ("b", 0, 2), ("c", 0, 2)]
    assert sorted(tuple(x) for x in found.executed.collect())[:3] == [("a", "company_website", 2001), ("a", "google_search", 1001), ("a", "one", 3001)]


def test_a_run_parses_each_page_once_and_only_pages_that_it_reads(spark, monkeypatch, tmp_path):
    def noted(name):
        real, folder = getattr(H, name), tmp_path / name
        folder.mkdir()
        parse, kind = real.func, real.returnType

        def note(html):
            for k, x in enumerate(html.to_pylist()):
                (folder / f"{uuid.uuid4().hex}-{k}").write_text(x)

        def content(html: pa.Array) -> pa.Array:
            note(html)
            return parse(html)

        def links(html: pa.Array, base: pa.Array) -> pa.Array:
            note(html)
            return parse(html, base)

        monkeypatch.setattr(H, name, F.arrow_udf(links if name == "page_links" else content, kind))
        return lambda: sorted(x.read_text() for x in folder.iterdir())

    contents, links = noted("page_content_or_error"), noted("page_links")
    payloads = [(s, "one", "q", _payload("http://n.com/1", "http://n.com/2", *more), None) for s, *more in (("a",), ("b", "http://n.com/broken"))]
    sites = [("a", "http://a.com", '<a href="/team">Our leadership</a>', None), ("a", "http://a.com/team", '<div class="team-member"><h2>Ann Lee</h2></div>', None), ("b", "http://b.com", '<a href="/team">Our leadership</a>', None), ("z", "http://z.com", "nobody's", None)]
    pages = [(f"http://n.com/{k}", f"<title>{k}</title>") for k in range(40)] + [("http://n.com/broken", BROKEN)]
    landed = Landed(spark.createDataFrame(payloads, "subject_id string, provider_id string, query string, payload string, error string"), spark.createDataFrame(sites, "subject_id string, url string, html string, error string"), spark.createDataFrame(pages, "url string, html string"))
    people = spark.createDataFrame([("a", 1, "http://a.com"), ("b", 2, None)], "subject_id string, seq long, url string")
    own = spark.createDataFrame([("company_website", ["company"], 1), ("one", ["search"], 1)], "provider_id string, phases array<string>, priority int")
    found = evidence.collect(people, own, landed, F.lit(NOW))
    seen = sorted((x["subject_id"], x["attribute"], x["value"]) for x in found.observations.collect())
    assert seen == [("a", "full_name", "Ann Lee"), ("a", "source_page", "http://a.com/team"), ("a", "web_page", "1"), ("a", "web_page", "2")]
    assert [x["subject_id"] for x in found.failures.collect()] == ["b"]
    assert sorted(tuple(x) for x in found.seen.collect()) == [("a", 2, 2), ("b", 0, 3)]
    assert contents() == [BROKEN, "<title>1</title>", "<title>2</title>"]
    assert links() == sorted(x[2] for x in sites[:2])


def test_a_page_that_cannot_be_parsed_gives_nothing_and_stops_nothing(spark):
    df = spark.createDataFrame([(1, BROKEN + "<a href='/x'>y</a>", "http://h.com"), (2, "<title>t</title><a href='/x'>y</a>", "http://h.com")], "k int, html string, url string")
    got = df.select("k", H.page_content_or_error("html").alias("c"), H.page_links("html", "url").alias("l"), H.page_elements("html").alias("e")).orderBy("k").collect()
    assert got[0]["c"]["error"] and got[0]["c"]["title"] is None and got[0]["l"] == [] and got[0]["e"] == []
    assert got[1]["c"]["error"] is None and got[1]["c"]["title"] == "t" and len(got[1]["l"]) == 1


def test_people_of_repeated_pages_all_stay(spark):
    a = '<div class="member"><h3>Ann</h3></div><div class="member"><h3>ann</h3></div><div class="member"><h3>Bo</h3></div>'
    df = spark.createDataFrame([("s", "u", a), ("s", "u", a), ("s", "v", a)], "subject_id string, url string, html string")
    people = H.page_people(df)
    assert sorted((r["url"], r["nth"], r["p"]["name"]) for r in people.collect()) == [("u", 0, "Ann"), ("u", 0, "Ann"), ("u", 2, "Bo"), ("u", 2, "Bo"), ("v", 0, "Ann"), ("v", 2, "Bo")]
    assert "Exchange" not in people._jdf.queryExecution().executedPlan().toString()


def test_a_crawl_goes_on_from_what_it_can_visit_only(spark):
    links = spark.createDataFrame([("r", f"c{k:02}", k) for k in range(20)] + [(f"c{k:02}", f"d{k:02}", 1) for k in range(20)] + [(f"d{k:02}", "r", 1) for k in range(20)], "url string, link string, score int")
    seeds = spark.createDataFrame([("s", "r"), ("t", "d01")], "site string, url string")
    got = sorted(tuple(x) for x in search.crawl(seeds, links, 4).collect())
    assert got == [("s", "c17", 1, 4), ("s", "c18", 1, 3), ("s", "c19", 1, 2), ("s", "r", 0, 1), ("t", "c18", 2, 4), ("t", "c19", 2, 3), ("t", "d01", 0, 1), ("t", "r", 1, 2)]


def test_runs_from_landed_tables_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("customer", "nation", "pages", "events"):
            db.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
        for name in ("run_attempts", "process_landed"):
            out = registry.queries()[name](spark, folder)
            peer = db.sql(registry.oracle_sql()[name])
            assert sorted(map(str, map(tuple, out.select(*peer.columns).collect()))) == sorted(map(str, peer.fetchall())), name


def test_the_first_of_a_run(spark):
    df = spark.createDataFrame([(k, 9 - k) for k in range(9)], "k int, seq int")
    assert [r["k"] for r in subjects.first(df, "seq", 3).collect()] == [8, 7, 6]
