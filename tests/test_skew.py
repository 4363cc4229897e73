"""Joins with hot keys, and identities of a value that a third of all records hold."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import skew
from dossier.operators import identity


def _sorted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [1, 100])
def test_a_salted_join_is_the_join(spark, how, most):
    left = spark.range(3000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN 'warm' WHEN id % 11 = 0 THEN NULL ELSE 'k' || id % 50 END").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), ("k5", 4), (None, 5), ("nobody", 6)], "k string, v int")
    out = skew.salted_join(left, right, ["k"], ["id"], how, hot=60, most=most)
    assert out.columns == left.join(right, "k", how).columns and _sorted(out) == _sorted(left.join(right, "k", how))


def test_hot_keys_are_few(spark):
    left = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert {tuple(r) for r in skew.hot_keys(left, ["k"], 30, 3).collect()} == {(0, 4), (1, 4), (2, 4)}
    assert skew.hot_keys(left, ["k"], 100).count() == 0
    with pytest.raises(ValueError, match="inner or left"):
        skew.salted_join(left, left, ["k"], ["k"], "full")


def test_a_common_value_is_spread(spark):
    """A phone that a third of all records hold, and 25 identities with it: the same candidates and scores, in even tasks."""
    n, hot = 6000, 100
    value = F.when(F.col("id") % 3 == 0, F.lit("common")).otherwise(F.concat(F.lit("p"), F.col("id")))
    a = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("ref"), F.lit(0).alias("position"), F.lit("phone").alias("signal_type"), value.alias("value"), F.lit("weak").alias("tier"))
    b = spark.range(300).select(F.format_string("i%03d", "id").alias("identity_id"), F.lit(0).alias("position"), F.lit("phone").alias("signal_type"), F.when(F.col("id") < 100, "common").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("value"))
    few, plain = identity.candidates(a, b, hot=hot), identity.candidates(a, b, hot=10 * n)
    assert _sorted(few) == _sorted(plain) and few.where("identity_id <= 'i024'").count() == 25 * n // 3
    assert _sorted(identity.scores(a, b, few)) == _sorted(identity.scores(a, b, plain))

    keys = ["signal_type", "value"]
    salts = skew.hot_keys(a, keys, hot)
    dealt = a.join(salts, keys, "left").select(F.pmod(F.xxhash64("value", F.pmod(F.xxhash64("ref"), F.coalesce("_salts", F.lit(1)))), F.lit(16)).alias("task"))
    sizes = sorted(r["count"] for r in dealt.groupBy("task").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]


def test_scores_in_a_records_row_are_those_of_its_pairs(spark):
    """Common names and phones, several values of a type, mails that differ: pairs scored without a join by identity."""
    n = 90
    people = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("ref0"), F.lit("Ann").alias("first_name"), F.format_string("Lee%d", F.col("id") % 2).alias("last_name"), F.format_string("m%d@x.com", F.col("id") % 40).alias("email"), F.format_string("%d", F.col("id") % 3).alias("phone"))
    table = spark.range(n).select(F.format_string("i%03d", "id").alias("subject_id"), F.format_string("Ann Lee%d", F.col("id") % 2).alias("name"), F.when(F.col("id") % 5 > 0, F.format_string("m%d@x.com", F.col("id") % 50)).alias("email"), F.format_string("%d", F.col("id") % 4).alias("phone"), F.lit(None).cast("string").alias("duns_number"))
    held = identity.stored_signals(table)
    again = held.where("signal_type = 'phone'").withColumns({"position": F.col("position") + 9, "value": F.lit("0")})
    held = held.unionByName(again.where("identity_id < 'i020'"))
    out = identity.resolve(people, "ref0", held)
    pairs = identity.candidates(out["signals"], held)
    assert _sorted(out["pairs"]) == _sorted(identity.scores(out["signals"], held, pairs)) and out["pairs"].count() == 25 * n
    assert "Join [identity_id" not in out["outcomes"]._jdf.queryExecution().executedPlan().toString()


def _odd(spark, n=60):
    """People, and signals of identities: titles that do not block, numbers that are strong alone, values that are not the last."""
    people = spark.range(n).select(F.format_string("r%02d", "id").alias("ref0"), F.lit("Ann").alias("first_name"), F.format_string("Lee%d", F.col("id") % 2).alias("last_name"), F.format_string("m%d@x.com", F.col("id") % 40).alias("email"), F.format_string("%d", F.col("id") % 3).alias("phone"), F.format_string("T%d", F.col("id") % 4).alias("title"))
    table = spark.range(n).select(F.format_string("i%03d", "id").alias("subject_id"), F.format_string("Ann Lee%d", F.col("id") % 2).alias("name"), F.when(F.col("id") % 5 > 0, F.format_string("m%d@x.com", F.col("id") % 50)).alias("email"), F.format_string("%d", F.col("id") % 4).alias("phone"), F.format_string("d%d", "id").alias("duns_number"))
    held = identity.stored_signals(table)
    again = held.where("signal_type = 'phone'").withColumns({"position": F.col("position") + 9, "value": F.lit("0")})
    titles = held.where("signal_type = 'full_name' and identity_id like '%3'").withColumns({"signal_type": F.lit("title"), "value": F.lit("t1")})
    return people, held.unionByName(again.where("identity_id < 'i020'")).unionByName(titles)


@pytest.mark.parametrize("independent", [1, 2, 3])
def test_candidates_that_are_not_weak_are_told_apart_before_they_are_scored(spark, independent):
    """Sure and doubtful ones are those of all candidates scored."""
    profile = identity.IdentityProfile(independent=independent)
    people, held = _odd(spark)
    numbers = spark.range(0, 60, 7).select(F.format_string("r%02d", "id").alias("ref"), F.lit(9).alias("position"), F.lit("duns_number").alias("signal_type"), F.format_string("d%d", F.col("id") % 30).alias("value"), F.lit("strong").alias("tier"))
    signals = identity.person_signals(people, "ref0").select(*numbers.columns).unionByName(numbers)
    want = {}
    for r in identity.scores(signals, held, identity.candidates(signals, held, profile), profile).collect():
        want.setdefault(r["ref"], []).append((r["identity_id"], r["score"], tuple(r["supporting"]), tuple(r["contradicting"]), r["reason"]))
    weak = lambda c: "never sufficient" in c[4]
    told = lambda c: c and (c["identity_id"], c["score"], tuple(c["supporting"]), tuple(c["contradicting"]))
    for r in identity.matched(signals, held, profile).collect():
        all_ = sorted(want[r["ref"]])
        assert [told(c) for c in r["scored"]] == [c[:4] for c in all_] and r["candidates"] == len(all_)
        assert [told(c) for c in r["sure"]] == [c[:4] for c in all_ if not weak(c)]
        assert told(r["doubtful"]) == next((c[:4] for c in all_ if weak(c)), None)


def test_a_review_queue_scores_a_record_once(spark):
    """The queue is that of the scored pairs, and no filter in its plan makes the scores again."""
    people, held = _odd(spark)
    out = identity.resolve(people, "ref0", held)
    bands = {}
    for r in out["pairs"].collect():
        bands.setdefault(r["ref"], []).append((-r["score"], r["identity_id"], r["band"], r["reason"]))
    decided = {r["ref"]: r for r in out["outcomes"].collect()}
    for ref, cs in bands.items():
        assert decided[ref]["rationale"] == f"{decided[ref]['decision']}: {min(cs)[3]}" and decided[ref]["candidates"] == len(cs)
    queue = [(ref, k, c[1], "open") for ref, cs in bands.items() if decided[ref]["decision"] == "candidate_review" for k, c in enumerate(sorted(c for c in cs if c[2] == "candidate_review"))]
    assert sorted(tuple(r) for r in out["review_queue"].collect()) == sorted(queue) and queue
    plan = out["review_queue"]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter " in x and "transform(" in x]
