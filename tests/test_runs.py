"""Whole runs, robots rules, streams, pages and storage on literal cases."""

from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.functions import html as H
from dossier.functions import text as X
from dossier.operators import cleaning, comparison, identity, providers, search, storage, subjects
from dossier.operators.cleaning import Profile
from dossier.operators.rules import RULES, ConfigurationError, Draft
from dossier.plans import record_queries, registry
from dossier.sources import landed

FOLDER = "/root/testdata/sf0.001"


def test_text_is_always_composed_and_numbers_read_plainly(spark):
    df = spark.createDataFrame([("Café", "Zoë ", 1.25e7)], "title string, first_name string, sales_usd double")
    r = cleaning.clean(df.withColumn("sales_usd", -F.col("sales_usd"))).first()
    assert r["title"] == "Café" and len(r["title"]) == 4 and r["first_name"] == "Zoë"
    assert any("(-12500000.0)" in w["message"] for w in r["warnings"])
    assert all(x["rule_version"] == 1 and x["at"] is not None for x in (*r["changes"], *r["warnings"]))
    values = [0.0, 1.0, -2.5, 1e7, 123456789.125, 1e15, 1e16, 1.5e17, 1e100, 1e-4, 1.25e-5, 3e-10]
    got = [x["t"] for x in spark.createDataFrame([(v,) for v in values], "v double").select(X.number(F.col("v")).alias("t")).collect()]
    assert got == [str(v) for v in values]


def test_a_broken_rule_is_a_failure_of_every_record(spark, monkeypatch):
    rule = next(r for r in RULES if r.id == "CLN-002")
    check = next(r for r in RULES if r.id == "CLN-009")
    monkeypatch.setitem(rule.__dict__, "apply", lambda r, p: 1 / 0)
    monkeypatch.setitem(check.__dict__, "apply", lambda r, p: [Draft(F.col("no_such_column"), "C", "m", ("title",))])
    df = spark.createDataFrame([("ann",), ("bob",)], "first_name string")
    out = cleaning.clean(df)
    assert [[f["rule_id"] for f in r["failures"]] for r in out.collect()] == [["CLN-002", "CLN-009"]] * 2
    m = {r["rule_id"]: r["failures"] for r in cleaning.rule_metrics(out).collect()}
    assert m["CLN-002"] == m["CLN-009"] == 2 and sum(m.values()) == 4 and cleaning.run_report(out).first()["failures"] == 2  # a failed check is counted for its rule only


def robots(spark, body, paths, agent="dossier", status=200):
    pages = spark.createDataFrame([(k, f"http://H.com{p}") for k, p in enumerate(paths)], "k int, url string")
    files = spark.createDataFrame([("h.com", status, body)], "host string, http_status int, body string")
    return [r["allowed"] for r in landed.allowed(pages, landed.robots_rules(files, agent)).orderBy("k").collect()]


@pytest.mark.parametrize(
    "body,paths,agent,want",
    [
        ("User-agent: *\nDisallow: /a\nAllow: /ab", ["/abc", "/b", ""], "dossier", [False, True, True]),
        ("User-agent: *  # all\nAllow: /ab\nDisallow: /a", ["/abc", "/a?x"], "dossier", [True, False]),
        ("User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b", ["/a", "/b"], "dossier", [False, True]),
        ("User-agent: *\nDisallow: /\n\nUser-agent: Dossier\nUser-agent: x\nDisallow: /q", ["/a", "/q"], "dossier/1.0", [True, False]),
        ("User-agent: other\nDisallow: /", ["/a"], "dossier", [True]),
        ("User-agent: *\nDisallow:\nDisallow: /a", ["/a"], "dossier", [True]),
        ("User-agent: *\n\nDisallow: /a", ["/a"], "dossier", [True]),
        ("user-agent: *\nCrawl-delay: 5\nDisallow: /a?x=1", ["/a?x=1", "/a"], "dossier", [False, True]),
    ],
)
def test_robots_first_match(spark, body, paths, agent, want):
    assert robots(spark, body, paths, agent) == want
    assert robots(spark, body.replace("\n", "\r\n"), paths, agent) == want
    assert robots(spark, body, paths, agent, 404) == [True] * len(paths)


def test_people_and_results_of_pages(spark):
    page = """<section class="team"><div class="team-member"><h2> </h2><span class="full-name">Ann Lee</span><p class="job">CEO</p><p>short</p><p>{w}</p><p>{w} more</p>
 <a href="MAILTO:a@x.com?s=1">m</a><a href="tel:+1 5">t</a></div><div id="person-2"><h3>Bob <b>Ray</b></h3><i class="role">Bob Ray</i><i class="role">CTO</i> b@y.org or 555 010 2000 x</div>
 <div class="staff"><h4>BOB RAY</h4><i class="title">cto</i></div><div class="bio"><p>nobody</p></div></section>""".format(w="word " * 9)
    out = H.page_people(spark.createDataFrame([(1, page), (2, None), (3, "<p>no one")], "k int, html string")).orderBy("nth").collect()
    assert [(r["k"], *r["p"]) for r in out] == [(1, "Ann Lee", "CEO", ("word " * 9) + "more", "a@x.com", "+1 5"), (1, "Bob Ray", "CTO", None, "b@y.org", "555 010 2000")]
    results = '<div class="g x"><h3>One</h3><a class=l href="/1">u</a><p class="s">said</p></div><div class=g><h3> </h3><a href="/2"></a></div><div class="g"><h3>Three</h3><a href="http://o.com/3">u</a></div><div class="g"><h3>Four</h3></div>'
    got = search.selected_results(spark.createDataFrame([(7, "http://s.com/q", results)], "page_id int, url string, html string"), "div.g", "h3", "a", "p.s", 2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(7, 1, "One", "http://s.com/1", "said"), (7, 2, "Three", "http://o.com/3", "")]


def test_profiles_of_coordination(spark):
    table = spark.createDataFrame([("a",), ("b",)], "provider_id string")
    rows = providers.CoordinationProfile(providers={"b": {"enabled": False, "max_age_days": 3}}).apply(table).orderBy("provider_id").collect()
    assert [(r["enabled"], r["max_age_days"], r["fallback_only"]) for r in rows] == [(True, 30, False), (False, 3, False)]
    for bad in ({"timeout_seconds": 0}, {"max_age_days": -1}):
        with pytest.raises(ConfigurationError):
            providers.CoordinationProfile(providers={"a": bad}).apply(table)


def test_rewrite_that_fails_keeps_the_table(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.range(3)
    storage.rewrite(df, path)
    real, calls = storage._move, []

    def broken(fs, source, target):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no")
        real(fs, source, target)

    monkeypatch.setattr(storage, "_move", broken)
    with pytest.raises(OSError):
        storage.rewrite(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and len(calls) == 3
    monkeypatch.setattr(storage, "_move", real)
    storage.rewrite(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9


def test_candidates_of_a_common_value_are_the_least(spark):
    a = spark.createDataFrame([(f"r{k}", "phone", "1") for k in range(40)], "ref string, signal_type string, value string")
    b = spark.createDataFrame([(f"i{k:03}", "phone", "1") for k in range(400)], "identity_id string, signal_type string, value string")
    out = identity.candidates(a, b)
    assert out.count() == 40 * 25 and out.agg(F.max("identity_id")).first()[0] == "i024"


def test_streams_equal_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM '{FOLDER}/events.parquet'")
        for name in ("stream_health", "stream_window_activity"):
            out = registry.queries()[name](spark, FOLDER)
            peer = db.sql(registry.oracle_sql()[name])
            assert sorted(out.columns) == sorted(peer.columns)
            assert sorted(map(str, out.select(*peer.columns).toPandas().values.tolist())) == sorted(map(str, peer.df().values.tolist())), name


def test_the_breaker_keeps_its_state_between_batches(spark, tmp_path):
    from dossier.streaming import health

    for k, oks in enumerate(([True, False, False], [False, True, False])):
        spark.createDataFrame([(1, 3 * k + i, ok) for i, ok in enumerate(oks)], "provider_id long, seq long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("provider_id long, seq long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = health.run_once(health.breaker(stream), "breaker_batches").orderBy("seq").collect()
    assert [r["consecutive_failures"] for r in out] == [0, 1, 2, 3, 0, 1] and out[3]["status"] == "unhealthy"


def test_a_run_of_subjects(spark):
    records = spark.createDataFrame([("a", "Ann", "Lee", "Manager", "x@y.z"), ("b", None, " ", "Chief", None), ("c", "Cy", "Ray", "Director", None), ("d", "Di", "Fox", "Clerk", None)], "subject_id string, first_name string, last_name string, title string, email string")
    seen = spark.createDataFrame([("a", "title", "Vice President", "p"), ("a", "full_name", "Ann Lee", "p"), ("b", "title", "X", "p"), ("d", "title", "Vice President", "p")], "subject_id string, attribute string, value string, provider_id string")
    failed = spark.createDataFrame([("d", "Comparison", "boom"), ("a", "Verification", "late"), ("a", "Search", "down"), ("b", "Search", "down")], "subject_id string, stage string, error string")
    stored = spark.createDataFrame([], storage.EXECUTIVES)
    run = subjects.process(records, "subject_id", seen, stored, F.expr("TIMESTAMP '2024-06-01 00:00:00'"), failures=failed)
    r = {x["subject_id"]: x for x in run.reports.collect()}
    assert {k: x["status"] for k, x in r.items()} == {"a": "partial", "b": "failed", "c": "success", "d": "failed"}
    assert r["a"]["errors"] == "Search failed: down; Verification failed: late" and r["b"]["errors"] == subjects.NO_NAME
    assert r["a"]["inflections_detected"] == "promotion" and "Vice President" in r["a"]["message"]
    # Nothing was looked at for c, so nothing is missing; d has evidence but was not compared; b was never identified.
    assert r["c"]["inflections_detected"] == "not_detected" and r["d"]["message"] is None and r["b"]["identity"] is None and r["c"]["identity"] == "new_identity"
    assert {x["subject_id"]: (x["title"], x["fields_updated"]) for x in run.stored.collect()} == {"a": ("Vice President", 1), "c": ("Director", 0), "d": ("Clerk", 0)}
    total = subjects.summary(run, seen).first()
    assert (total["subjects"], total["failed"], total["errors"], total["fields_updated"], total["inflections"], total["success_rate"]) == (4, 2, 4, 1, 1, 25.0)


def test_fuzzy_verdicts_against_difflib(spark):
    """Every verdict of the whole table, recomputed row by row."""
    limits = {f: (s, t) for f, s, t, _ in comparison.ComparisonProfile().rules}
    fold = lambda x: " ".join(x.split()).lower()
    rows = registry.queries()["cmp_verdicts_fuzzy"](spark, FOLDER).collect()
    settled = 0
    for r in rows:
        if r["status"] not in ("match", "changed"):
            assert r["similarity"] is None
            continue
        kind, limit = limits[r["field"]]
        if kind == "fuzzy":
            a, b = fold(r["existing"]), fold(r["new"])
            want = SequenceMatcher(None, a, b).ratio() if a != b else 1.0
            settled += a != b
            assert r["similarity"] == round(want, 6) and (r["status"] == "match") == (want >= limit)
        else:
            assert (r["status"] == "match") == (r["similarity"] == 1.0)
    assert settled > 10
    fuzzy = {r["subject_id"]: r for r in record_queries.QUERIES["process_subjects_fuzzy"](spark, FOLDER).collect()}
    exact = {r["subject_id"]: r for r in record_queries.QUERIES["process_subjects"](spark, FOLDER).collect()}
    assert fuzzy.keys() == exact.keys() and all(fuzzy[k]["status"] == exact[k]["status"] and fuzzy[k]["identity"] == exact[k]["identity"] for k in fuzzy)


def test_presence_by_all(spark):
    from dossier.operators import rules

    df = spark.createDataFrame([("a", "b", None), ("a", None, None), ("a", "b", "c")], "x string, y string, z string")
    record = rules.Record({c: F.col(c) for c in df.columns}, dict(df.dtypes))
    said = lambda **k: [r["w"] for r in df.select(F.coalesce(rules.presence("C", "m", ("x", "y"), ("y", "z"), **k)(record, {})[0].when, F.lit(False)).alias("w")).collect()]
    assert said() == [False, True, False] and said(all_trigger=True) == [False, False, False] and said(all_required=True) == [True, True, False]
    assert Profile().enabled("CLN-050")


def test_robots_rules_in_any_encoding_as_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser

    body = "User-agent: *\nDisallow: /a%20b\nDisallow: /ét\nDisallow: /q?x\nDisallow: /p%2Bq\nDisallow: /100%25\nAllow: /z%zz\nDisallow: /z\nDisallow: /e?\nDisallow: /k%2Fl\n"
    paths = ["/a%20b", "/a b/c", "/A%20b", "/%c3%a9t%C3%A9", "/été", "/et", "/q%3Fx=1", "/q?x", "/q?y", "/p+q", "/p%20q", "/p%2bq", "/100%", "/100%25", "/100", "/a%2520b", "/%61%20b", "/z%zz", "/z%25zz", "/z1", "/e", "/e?", "/e?a", "/k/l", "/k%2fl", "/k", "", "/%"]
    peer = RobotFileParser()
    peer.parse(body.splitlines())
    assert robots(spark, body, paths) == [peer.can_fetch("dossier", f"http://H.com{p}") for p in paths]
