"""Rules that raise for some records, and metrics that count them."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from dossier.functions import guard
from dossier.operators import cleaning
from dossier.operators.cleaning import Profile
from dossier.operators.rules import BUSINESS, RULES, SAFE, WARNING, ConfigurationError, Draft, Rule

ROWS = [(1, " ann ", "12", 5.0), (2, " bob ", "boom", 1e300), (3, None, None, None), (4, "  eve", "7", -1.5)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k int, first_name string, duns_number string, sales_usd double")


def test_packed_keeps_values_and_marks_what_raises(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "+é")], "k int, t string")
    bad = F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("t"))
    c = df.select("k", guard.packed(bad).alias("a"), guard.packed(F.col("t").cast("int")).alias("b"), guard.packed(F.element_at(F.split("t", "5"), 2)).alias("c"))
    got = c.select("k", guard.raised(F.col("a")).alias("ra"), guard.unpacked(F.col("a"), "string").alias("a"), guard.raised(F.col("b")).alias("rb"), guard.unpacked(F.col("b"), "int").alias("b"), guard.raised(F.col("c")).alias("rc"))
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, False, "5", False, 5, False), (2, True, None, True, None, True), (3, False, None, False, None, False), (4, False, "+é", True, None, True)]


@pytest.mark.parametrize("kind,value", [("double", 0.1 + 0.2), ("double", float("-inf")), ("double", -1e-310), ("float", 0.5), ("bigint", -(1 << 63)), ("boolean", True), ("date", datetime.date(1969, 2, 28)), ("timestamp", datetime.datetime(2024, 5, 1, 2, 3, 4, 567891)), ("decimal(38,4)", decimal.Decimal("-12345678901234567890.1234")), ("string", "a\nb\0c")])
def test_packed_values_come_back(spark, kind, value):
    df = spark.createDataFrame([(value,), (None,)], f"v {kind}")
    got = df.select(F.col("v").eqNullSafe(guard.unpacked(guard.packed(F.col("v")), kind)).alias("same"), guard.raised(guard.packed(F.col("v"))).alias("r")).collect()
    assert [tuple(r) for r in got] == [(True, False)] * 2


def _own():
    def python_rule(text):
        if text == "ann":
            raise KeyError("ann is unknown")
        return None if text is None else text.upper()

    def numbered(r, p):
        return {"duns_number": r.any("duns_number").cast("int").cast("string")}

    def twice(r, p):  # writes two fields, of which one raises
        return {"first_name": F.concat(r.any("first_name"), F.lit("!")), "sales_usd": F.when(r.any("sales_usd") < 0, F.raise_error(F.lit("negative"))).otherwise(r.any("sales_usd") + 1)}

    def result(r, p):
        return {"sales_usd": F.when(r.any("sales_usd") > 1e100, guard.fail("too large")).otherwise(guard.ok(r.any("sales_usd")))}

    return (
        Rule("OWN-1", "number", "own", SAFE, ("duns_number",), numbered, version=4),
        Rule("OWN-2", "python", "own", BUSINESS, ("first_name",), lambda r, p: {"first_name": guard.python(python_rule, "string")(r.any("first_name"))}),
        Rule("OWN-3", "two fields", "own", BUSINESS, ("first_name", "sales_usd"), twice, touches=lambda r, p: F.lit(True)),
        Rule("OWN-4", "result", "own", BUSINESS, ("sales_usd",), result),
        Rule("OWN-5", "refused", "own", BUSINESS, ("x",), lambda r, p: {"x": F.col("nowhere")}),
        Rule("OWN-6", "broken", "own", BUSINESS, ("x",), lambda r, p: {}["x"]),
        Rule("OWN-7", "check", "own", WARNING, ("duns_number",), lambda r, p: [Draft(F.lit(True), "SEEN", "Seen.", ("k",)), Draft(r.any("duns_number").cast("int") > 7, "BIG", F.concat(F.lit("Number "), r.any("duns_number")), ("duns_number",))]),
        Rule("OWN-8", "broken check", "own", WARNING, ("x",), lambda r, p: [Draft(F.col("nowhere"), "X", "x", ("x",))]),
    )


def test_a_record_for_which_a_rule_raises_loses_only_that_rule(spark):
    profile = Profile(rules=(*RULES, *_own()), only=("CLN-001", "OWN-1", "OWN-2", "OWN-3", "OWN-4", "OWN-5", "OWN-6", "OWN-7", "OWN-8"))
    out = cleaning.clean(frame(spark), profile, F.lit("2024-06-01").cast("timestamp"))
    rows = {r["k"]: r for r in out.collect()}
    assert [(r["first_name"], r["duns_number"], r["sales_usd"]) for _, r in sorted(rows.items())] == [("ann!", "12", 6.0), ("BOB!", "boom", 1e300), (None, None, None), ("EVE", "7", -1.5)]
    always = {("OWN-5", "business"), ("OWN-6", "business"), ("OWN-8", "warning")}
    failed = {k: {(f["rule_id"], f["stage"]) for f in r["failures"]} - always for k, r in rows.items()}
    assert failed == {1: {("OWN-2", "business")}, 2: {("OWN-1", "safe"), ("OWN-4", "business"), ("OWN-7", "warning")}, 3: set(), 4: {("OWN-3", "business")}}
    assert all(always <= {(f["rule_id"], f["stage"]) for f in r["failures"]} for r in rows.values())
    said = {f["rule_id"]: (f["error_message"], f["rule_version"]) for r in rows.values() for f in r["failures"]}
    assert said["OWN-2"] == ("'ann is unknown'", 1) and said["OWN-4"] == ("too large", 1) and said["OWN-1"] == ("OWN-1 raised an error for this record", 4)
    changed = {k: [(c["rule_id"], c["field_name"], c["old_value"], c["new_value"]) for c in r["changes"]] for k, r in rows.items()}
    assert changed[2] == [("CLN-001", "first_name", " bob ", "bob"), ("OWN-2", "first_name", "bob", "BOB"), ("OWN-3", "first_name", "BOB", "BOB!")] and changed[3] == []
    assert changed[4] == [("CLN-001", "first_name", "  eve", "eve"), ("OWN-2", "first_name", "eve", "EVE")]
    assert {k: [w["message"] for w in r["warnings"]] for k, r in rows.items()} == {1: ["Seen.", "Number 12"], 2: [], 3: ["Seen."], 4: ["Seen."]}
    assert rows[1]["affected"] == ["CLN-001", "OWN-3"] and rows[4]["affected"] == ["CLN-001", "OWN-2"] and rows[3]["affected"] == ["OWN-3"]
    m = {r["rule_id"]: r for r in cleaning.rule_metrics(out, profile).collect()}
    assert len(m) == len(RULES) + 8
    one = lambda k: tuple(m[k][c] for c in ("rule_version", "records_evaluated", "records_skipped", "records_affected", "changes", "warnings", "failures"))
    assert one("OWN-1") == (4, 4, 0, 0, 0, 0, 1) and one("OWN-3") == (1, 4, 0, 3, 3, 0, 1) and one("OWN-7") == (1, 4, 0, 3, 0, 4, 1) and one("OWN-5") == (1, 4, 0, 0, 0, 0, 4)
    assert one("CLN-002") == (1, 0, 4, 0, 0, 0, 0) and one("CLN-001") == (1, 4, 0, 3, 3, 0, 0)
    # A check's failure is counted for the rule, not for the run.
    assert tuple(cleaning.run_report(out).first()) == (4, 3, 3, 4, 8, 4, 4 * 2 + 4)
    assert cleaning.failure_rows(out, "k").where("stage = 'warning' and rule_id = 'OWN-7'").select("k").collect() == [(2,)]


def test_observed_totals_are_the_report(spark):
    out, seen = cleaning.observed(cleaning.clean(frame(spark)))
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == cleaning.run_report(cleaning.clean(frame(spark))).first().asDict()


def test_own_rules_see_composed_and_later_values(spark):
    from dossier.operators.rules import whitespace

    again = Rule("OWN-1", "again", "own", SAFE, ("first_name",), lambda r, p: {"first_name": F.concat(r.composed("first_name"), F.lit("?"))}, total=True)
    last = Rule("OWN-2", "space", "own", SAFE, ("first_name",), whitespace("first_name"), total=True)
    df = spark.createDataFrame([(1, " Café ")], "k int, first_name string")
    r = cleaning.clean(df, Profile(rules=(*RULES, again, last), only=("CLN-001", "OWN-1", "OWN-2"))).first()
    assert r["first_name"] == "Café?" and [c["new_value"] for c in r["changes"]] == ["Café", "Café?"]


def test_profiles_with_own_rules_are_checked():
    with pytest.raises(ConfigurationError):
        Profile(rules=(*RULES, RULES[0])).validate()
    with pytest.raises(ConfigurationError):
        Profile(rules=(*RULES, *_own()), enabled_rules={"OWN-1": False}).validate()
    Profile(rules=(*RULES, *_own()), enabled_rules={"OWN-2": False}).validate()
