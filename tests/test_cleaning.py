"""Rules and the cleaning pipeline on literal cases."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import cleaning
from dossier.operators.cleaning import Profile
from dossier.operators.rules import BUSINESS, RULES, SAFE, ConfigurationError


def run(spark, field, values, only, **params):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {field} string")
    return [r for r in cleaning.clean(df, Profile(only=only, parameters=params.get("parameters", {}))).orderBy("k").collect()]


def test_registry():
    assert [r.id for r in RULES if r.stage == SAFE] and len(RULES) == 68 == len({r.id for r in RULES})
    assert sorted(r.id for r in RULES) == [f"CLN-{n:03}" for n in range(1, 69)]
    assert len([r for r in RULES if r.stage == SAFE]) == 13
    business = [r for r in RULES if r.stage == BUSINESS]
    assert len(business) == 21 and sum(r.default for r in business) == 7


@pytest.mark.parametrize(
    "field,rule,cases",
    [
        ("first_name", "CLN-002", {"JEAN-luc": "Jean-Luc", "van DER berg": "van der Berg", "o'brien": "O'Brien", "macy": "MacY", "mc": "Mc", "": ""}),
        ("title", "CLN-004", {"ceo, r&d": "CEO, R&D", "it/hr": "IT/HR", "Pace": "Pace", "b2b-vp": "B2B-VP"}),
        ("title", "CLN-005", {"sr. vp": "Senior Vice President", "Jr analyst": "Junior analyst"}),
        ("email", "CLN-013", {"A@X.COM": "A@x.com", "no": "no", "a@B@C": "a@B@c"}),
        ("email", "CLN-014", {"A.b@X.COM": "a.b@X.COM"}),
        ("phone", "CLN-012", {"''555": "555", " 1 ": "1"}),
        ("duns_number", "CLN-025", {" 12  3 ": "12  3"}),
        ("company_name", "CLN-027", {"eBAY, LLC": "eBay, Llc", "acme  co": "Acme  Co"}),
        ("is_headquarters", "CLN-028", {"Yes": "true", " 0 ": "false", "maybe": "maybe"}),
        ("url", "CLN-057", {"acme.com/x": "https://acme.com/x", "http://a.b": "http://a.b", "none": "none"}),
        ("address_line_1", "CLN-036", {"  ": None, "x": "x"}),
        ("sales_usd", "CLN-044", {"N/A": None, "null": None, "5": "5"}),
    ],
)
def test_normalizations(spark, field, rule, cases):
    out = run(spark, field, [*cases, None], (rule,))
    assert [r[field] for r in out] == [*cases.values(), None]
    for r, (old, new) in zip(out, cases.items()):
        assert [(c["old_value"], c["new_value"]) for c in r["changes"]] == ([(old, new)] if old != new else [])


def test_parameters(spark):
    assert [r["company_name_normalized"] for r in run(spark, "company_name", ["Acme inc.", "Acme L.L.C.", "Acme, Limited", None], ("CLN-026",))] == ["Acme Inc.", None, "Acme Ltd.", None]
    assert [r["company_name_normalized"] for r in run(spark, "company_name", ["Acme inc"], ("CLN-026",), parameters={"CLN-026": {"mode": "strip"}})] == ["Acme"]
    assert [(r["last_name"], r["name_suffix"]) for r in run(spark, "last_name", ["Smith jr.", "Ives"], ("CLN-003",), parameters={"CLN-003": {"strip": True}})] == [("Smith", "jr."), ("Ives", None)]
    assert [r["phone"] for r in run(spark, "phone", ["(555) 010-2000", "15550102000", "+44 20", "call"], ("CLN-016",), parameters={"CLN-016": {"default_region": "US"}})] == ["+15550102000", "+15550102000", "+4420", "call"]
    assert [r["postal_code"] for r in run(spark, "postal_code", ["12345-6789", "x"], ("CLN-039",), parameters={"CLN-039": {"target": "5_digit"}})] == ["12345", "x"]
    assert run(spark, "title", ["Café"], ("CLN-001",))[0]["title"] == "Café"


def test_configuration_errors():
    for bad in (
        Profile(enabled_rules={"CLN-016": True}), Profile(enabled_rules={"CLN-045": True}), Profile(enabled_rules={"CLN-001": False}), Profile(enabled_rules={"CLN-099": True}),
        Profile(enabled_rules={"CLN-016": True, "CLN-067": True}, parameters={"CLN-016": {"default_region": "US"}, "CLN-067": {"default_region": "US"}}),
        Profile(enabled_rules={"CLN-046": True}, parameters={"CLN-046": {"scale": "dozens"}}), Profile(name=" "),
    ):
        with pytest.raises(ConfigurationError):
            bad.validate()


def test_later_rules_see_earlier_output_and_primary_phone_keeps_its_form(spark):
    df = spark.createDataFrame([("'555 0100 ", None, "US")], "direct_phone string, phone string, country string")
    r = cleaning.clean(df, Profile(enabled_rules={"CLN-067": True}, parameters={"CLN-067": {"default_region": "US"}})).first()
    assert r["direct_phone"] == "+15550100" and r["primary_phone"] == "555 0100"


def test_warnings_carry_code_message_and_fields(spark):
    df = spark.createDataFrame([("Ann", "Ann", "x" * 101, "a@b", "info@x.com")], "first_name string, last_name string, title string, company_email string, email string")
    notes = {w["code"]: w for w in cleaning.clean(df).first()["warnings"]}
    assert notes["IDENTICAL_FIRST_LAST_NAME"]["field_names"] == ["first_name", "last_name"]
    assert notes["TITLE_UNUSUALLY_LONG"]["message"] == "Title is 101 characters, exceeding the 100-character threshold."
    assert "MALFORMED_EMAIL_SHAPE" in notes and "ROLE_BASED_EMAIL_PATTERN" in notes and "MISSING_COMPANY_NAME" in notes


def test_mapping_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x")], "row_number int, `First Name` string")
    mapped = cleaning.map_fields(df)
    assert mapped.columns[0] == "row_number" and mapped.first()["first_name"] == "x" and mapped.first()["url"] is None
    assert cleaning.clean(mapped.limit(0)).count() == 0
    assert cleaning.run_report(cleaning.clean(mapped)).first()["records"] == 1
    assert cleaning.audit_trail(cleaning.clean(mapped), "row_number").where(F.col("kind") == "warning").count() > 0


def test_affected_counts_more_than_changes(spark):
    r = run(spark, "title", ["CEO", "ceo", "Painter"], ("CLN-004",))
    assert [(len(x["changes"]), x["affected"]) for x in r] == [(0, ["CLN-004"]), (1, ["CLN-004"]), (0, [])]
    df = spark.createDataFrame([("CEO",), ("ceo",), ("Painter",)], "title string")
    p = Profile(only=("CLN-004",))
    m = cleaning.rule_metrics(cleaning.clean(df, p), p).where("rule_id = 'CLN-004'").first()
    assert (m["records_affected"], m["changes"], m["records_evaluated"]) == (2, 1, 3)


def test_reports_of_a_whole_run_equal_sql(spark):
    from collections import Counter

    import duckdb

    from dossier.plans import registry

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("customer", "nation"):
            db.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
        for name in ("clean_audit_trail_all", "clean_rule_metrics_all", "clean_run_report_all"):
            out = registry.queries()[name](spark, folder)
            peer = db.sql(registry.oracle_sql()[name])
            assert sorted(out.columns) == sorted(peer.columns)
            out = out.select(*peer.columns)
            assert Counter(map(tuple, out.collect())) == Counter(peer.fetchall()), name
            if name == "clean_rule_metrics_all":
                assert {r["rule_id"] for r in out.where("records_evaluated > 0").collect()} == {r.id for r in RULES if r.default} and out.where("records_skipped > 0").count() == 68 - 54
