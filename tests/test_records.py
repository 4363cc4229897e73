"""Comparison, inflection, identity, providers, storage, reports and sources on literal cases."""

import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.functions import urls as U
from dossier.operators import comparison, evaluation, extraction, identity, inflection, providers, search, simulation, storage
from dossier.operators.rules import ConfigurationError
from dossier.sources import xlsx


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_seniority_and_similarity(spark):
    titles = {"CTO": 12, "contractor": 12, "Director": 6, "Managing Director": 7, "Executive Vice President": 10, "Painter": None, "CEO": 13, " intern ": 1}
    assert values(spark, inflection.seniority, titles) == list(titles.values())
    pairs = [("tide", "diet"), ("diet", "tide"), ("Chief Experience Officer", "Chief Executive Officer"), ("a", None)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(X.sequence_ratio("a", "b")).collect()]
    assert got[:3] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs[:3]] and got[0] == 0.25 and got[1] == 0.5
    assert got[3] is None or got[3] != got[3]


def test_urls(spark):
    assert values(spark, U.result_key, ["http://A.com/x/?q=1#f", "http://a.com/", "https://a.com:80/b/"]) == ["http://a.com/x?q=1", "http://a.com/", "https://a.com:80/b"]
    assert values(spark, U.crawl_key, ["http://a.com/#x", "http://a.com/b/"]) == ["http://a.com", "http://a.com/b"]
    assert values(spark, U.host, ["https://www.Linkedin.com/in", "https://uk.linkedin.com"]) == ["linkedin.com", "uk.linkedin.com"]
    assert values(spark, lambda c: search.confidence(c, F.lit("news_search")), ["https://www.linkedin.com/in", "https://uk.linkedin.com"]) == [0.98, 0.92]


def _case(spark, observed, fuzzy=True):
    people = spark.createDataFrame([("a", "Ann", "Lee", "Director", "Acme", "a@x.com", None)], "subject_id string, first_name string, last_name string, title string, company_name string, email string, phone string")
    seen = spark.createDataFrame([("a", *o) for o in observed], "subject_id string, attribute string, value string")
    v = comparison.verdicts(people, "subject_id", seen, fuzzy=fuzzy)
    return v, {r["field"]: r for r in v.collect()}


def test_verdicts(spark):
    _, got = _case(spark, [("full_name", "ann  LEE"), ("title", "Vice President"), ("company_name", "Acme"), ("company_name", "Other"), ("phone", "+1 555")])
    assert {f: r["status"] for f, r in got.items()} == {"name": "match", "title": "changed", "company": "conflict", "email": "missing", "phone": "new"}
    assert got["company"]["conflicting"] == ["Acme", "Other"] and got["name"]["similarity"] == 1.0
    assert got["title"]["explanation"].startswith("fuzzy comparison: differs (score=0.")
    _, none = _case(spark, [("title", "  ")])
    assert none["phone"]["status"] == "unknown" and none["title"]["status"] == "missing"


def test_inflections_and_messages(spark):
    v, _ = _case(spark, [("full_name", "Ann Lee"), ("title", "CEO"), ("company_name", "Beta {title}")])
    events = inflection.detect(v)
    got = {r["type"]: r["confidence"] for r in events.collect()}
    assert set(got) == {"promotion", "company_change"} and got["promotion"] == pytest.approx(0.9)
    m = inflection.messages(events, v).first()
    assert m["type"] == "company_change" and m["message"].startswith("Hi Ann Lee, congratulations on your new role as CEO at Beta {title}!")
    v, _ = _case(spark, [("full_name", "Ann Lee")])
    assert [r["type"] for r in inflection.detect(v).collect()] == ["possible_resignation"]
    with pytest.raises(ConfigurationError):
        inflection.detect(v, {"INF-001": 2.0})


def test_identity_scores_gate_and_no_cartesian_product(spark):
    people = spark.createDataFrame([("r", "Ann", "Lee", "a@x.com", "1"), ("s", "Bo", "Day", "b@x.com", "2"), ("t", None, None, None, None)], "ref0 string, first_name string, last_name string, email string, phone string")
    table = spark.createDataFrame([("i1", "Ann Lee", "a@x.com", "1", None), ("i2", "Ann Lee", "z@x.com", "9", None), ("i3", "Bo Day", "b@x.com", None, None)], "subject_id string, name string, email string, phone string, duns_number string")
    out = identity.resolve(people, "ref0", identity.stored_signals(table))
    got = {(r["ref"], r["identity_id"]): r for r in out["pairs"].collect()}
    assert got["r", "i1"]["score"] == pytest.approx(0.77) and got["r", "i1"]["band"] == "candidate_review"
    assert got["r", "i2"]["score"] == 0 and got["r", "i2"]["reason"].startswith("No Strong-tier signal")
    assert got["s", "i3"]["reason"] == "score=0.650 -> candidate_review; supporting=[email_exact, full_name]; contradicting=[none]"
    decided = {r["ref"]: r for r in out["outcomes"].collect()}
    assert decided["r"]["decision"] == "candidate_review" and decided["t"]["decision"] == "new_identity" and len(decided["t"]["new_id"]) == 64
    assert "Cartesian" not in out["pairs"]._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ConfigurationError):
        identity.IdentityProfile(auto_merge=0.2).validate()


def test_health_fold_and_replay(spark):
    rows = [(1, k, ok) for k, ok in enumerate([False, False, True, False, False, False, True])]
    df = spark.createDataFrame(rows, "provider_id int, seq int, ok boolean")
    assert [r["status"] for r in providers.health(df).orderBy("seq").collect()] == ["degraded", "degraded", "healthy", "degraded", "degraded", "unhealthy", "healthy"]
    assert [r["ran"] for r in providers.replay(df).orderBy("seq").collect()] == [True] * 6 + [False]
    with pytest.raises(ConfigurationError):
        providers.register(spark.createDataFrame([("a",), ("a",)], "provider_id string"))


def test_facts(spark):
    rows = [("News", "Mary Ann Smith was appointed as the Chief Executive Officer of Acme Corp. More."), ("Jane Doe, Editor at Daily Bugle", "x"), ("", "nothing")]
    out = extraction.facts(spark.createDataFrame(rows, "title0 string, body string"), "title0", "body").collect()
    assert (out[0]["fact"]["full_name"], out[0]["fact"]["title"], out[0]["fact"]["company_name"]) == ("Mary Ann Smith", "Chief Executive Officer", "Acme Corp")
    assert out[1]["fact"]["pattern"].startswith("FACT-004") and out[2]["fact"] is None and out[0]["event_keywords"] == "appointment"


def test_people_on_a_page(spark):
    html = '<div class="team-member"><h3>Ann Lee</h3><p class="role">CEO</p><p>' + "word " * 12 + '</p><a href="mailto:a@x.com?s=1">m</a></div><div class="team-member"><h3>Ann Lee</h3><p class="role">ceo</p></div>'
    got = {r["attribute"]: r["value"] for r in extraction.person_observations(spark.createDataFrame([("s", "http://x", html)], "subject_id string, url string, html string")).collect()}
    assert got["full_name"] == "Ann Lee" and got["title"] == "CEO" and got["email"] == "a@x.com" and len(got["biography"]) >= 40


def test_storage_round(spark, tmp_path):
    now = F.expr("TIMESTAMP '2024-06-01 00:00:00'")
    records = spark.createDataFrame([("a", "Ann", "x", "c", "e", None, None, None)], "subject_id string, name string, title string, company string, email string, phone string, duns_number string, url string")
    first = storage.baseline_insert(spark.createDataFrame([], storage.EXECUTIVES), records, now)
    assert storage.baseline_insert(first, records, now).count() == 0
    compared = spark.createDataFrame([("a", "title", "changed", "CEO"), ("a", "email", "missing", None)], "ref string, field string, status string, new string")
    best = spark.createDataFrame([("a", "promotion", 0.9, "why")], "ref string, type string, confidence double, explanation string")
    r = storage.apply_changes(first, compared, best, compared.select("ref"), F.expr("TIMESTAMP '2024-07-01 00:00:00'")).first()
    assert (r["title"], r["email"], r["fields_updated"], r["last_inflection_type"]) == ("CEO", "e", 1, "promotion") and r["updated_at"] > r["created_at"]
    path = str(tmp_path / "t")
    storage.rewrite(first, path)
    storage.rewrite(spark.read.parquet(path).withColumn("title", F.lit("new")), path)
    assert spark.read.parquet(path).first()["title"] == "new"


def test_reports(spark, tmp_path):
    row = spark.createDataFrame([("a", "success", "valid", "", "company_website", "promotion", 2)], "subject_id string, status string, verification_status string, errors string, providers_executed string, inflections_detected string, company_website_results_found long")
    s = evaluation.summary(row)
    assert s.first()["success_rate"] == 100.0 and s.first()["verification_success_rate"] == 100.0 and s.first()["promotions_detected"] == 1
    assert evaluation.summary(row.limit(0)).first()["success_rate"] == 0.0
    evaluation.write_both(row, s, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "rows"), header=True).count() == 1


def test_simulation(spark):
    got = [r["promoted"] for r in simulation.promoted_titles(spark.createDataFrame([("a", "Manager"), ("b", "Chief Experience Officer"), ("c", None)], "ref string, title string"), "ref", "title").orderBy("ref").collect()]
    assert got == ["Director", "President and Chief Executive Officer", "President and Chief Executive Officer"]


def _book(path, rows, extra=""):
    def cell(v):
        return "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    _book(path, [["Name", None, "Name"], ["a", 7, "007"], [None, None, None], ["b", 1.5, None]])
    df, warnings, meta = xlsx.read_workbook(spark, path)
    rows = df.orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == [2, 4] and rows[0]["values"] == {"Name": "007", "Unnamed: 1": "7"} and rows[0]["value_types"]["Unnamed: 1"] == "int"
    assert {r["code"] for r in warnings.collect()} == {"DUPLICATE_COLUMN", "SKIPPED_BLANK_ROW"} and meta["row_count"] == 2
    with pytest.raises(xlsx.FileMissing):
        xlsx.Workbook(str(tmp_path / "no.xlsx"))
    with pytest.raises(xlsx.UnsupportedFile):
        xlsx.Workbook(__file__)
    _book(path, [["Name"]])
    with pytest.raises(xlsx.EmptySource):
        xlsx.read_workbook(spark, path)
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(xlsx.CorruptedSource):
        xlsx.Workbook(str(tmp_path / "bad.xlsx"))


def test_queries_are_told_apart_in_the_subjects_row(spark):
    rows = [("s", " Ann Lee ", "X", "CEO"), ("s", "Ann Lee", "X", None), ("t", "Ann Lee", None, "CEO"), ("u", None, "X", "CEO")]
    subjects = spark.createDataFrame(rows, "subject_id string, name string, company string, title string")
    made = providers.queries(subjects, "linkedin_search")
    got = sorted((r["subject_id"], r["position"], r["query"]) for r in made.collect())
    assert got[:6] == [("s", k, q) for k, q in enumerate(['"Ann Lee" "X"', '"Ann Lee" "CEO"', '"Ann Lee" new position', '"Ann Lee" promoted', '"Ann Lee" joined "X"', '"Ann Lee"'])]
    assert [x[:2] for x in got[6:]] == [("t", 1), ("t", 2), ("t", 3), ("t", 5)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange")  # queries are made above the only shuffle
    counts = {(r["provider"], r["sent"]): r["subjects"] for r in providers.request_counts(subjects.where("company is not null or title = 'CEO'").dropDuplicates(["subject_id"])).collect()}
    assert counts["linkedin_search", '"Ann Lee"'] == 2 and counts["google_search", '"Ann Lee" "X"'] == 1


def test_cut_references_in_titles_and_results_in_pieces(spark):
    from dossier.functions import html

    titles = ["a &amp; b", "a &amp;&amp", "R&D &lt;x&gt; &#x27;", "&ampx; &am"]
    rows = [(k, f"<html><head><title>{t}</title></head><body><a href='/{k}'>l</a></body></html>") for k, t in enumerate(titles * 20)] + [(80, None)]
    df = spark.createDataFrame(rows, "k int, x string").coalesce(1)
    got = df.select("k", html.page_content(F.col("x"))["title"].alias("t"), html.page_links(F.col("x"), F.lit("http://h/")).alias("l")).orderBy("k").collect()
    assert [r["t"] for r in got[:4]] == ["a & b", "a &&amp", "R&D <x> '", "&ampx; &am"] and got[80]["t"] == "" and got[80]["l"] == []
    assert [r["l"][0]["url"] for r in got[:80]] == [f"http://h/{k}" for k in range(80)]
