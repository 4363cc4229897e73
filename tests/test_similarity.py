"""difflib's ratio: what can be said of it without searching."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import comparison
from dossier.plans import record_queries

FOLDER = "/root/testdata/sf0.001"


def _pairs():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé 1") for _ in range(r.randint(0, 12)))
    out = [(word(), word()) for _ in range(600)]
    out += [(a, a[: len(a) // 2] + b + a[len(a) // 2 :]) for a, b in [(word(), word()) for _ in range(200)]]
    out += [(a + b, a + c) for a, b, c in [(word(), word(), word()) for _ in range(200)]] + [(a, a + b) for a, b in out[:100]]
    long = "".join(r.choice("ab c") for _ in range(230))
    return [*out, ("", ""), ("", "x"), ("ab", long), (long, "ab"), (long, long[:120]), (long, long[40:] + "z"), ("日本語", "本"), ("a.b$", "$b.a")]


def test_closed_forms_and_bounds_hold_difflibs_ratio(spark):
    a, b = F.col("a"), F.col("b")
    low, high = X.ratio_bounds(a, b)
    rows = spark.createDataFrame(_pairs(), "a string, b string").select("a", "b", X.ratio_known(a, b).alias("known"), low.alias("low"), high.alias("high")).collect()
    known = 0
    for r in rows:
        ratio = SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["low"] <= ratio + 1e-12 and ratio <= r["high"] + 1e-12, r
        if r["known"] is not None:
            known += 1
            assert abs(r["known"] - ratio) < 1e-12, r
    assert known > 200


def test_statuses_are_the_same_with_and_without_scores(spark):
    p, o = record_queries.people(spark, FOLDER), record_queries.observed(spark, FOLDER)
    full = {(r["ref"], r["field"]): r for r in comparison.verdicts(p, "subject_id", o).collect()}
    fast = {(r["ref"], r["field"]): r for r in comparison.verdicts(p, "subject_id", o, scores=False).collect()}
    assert full.keys() == fast.keys() and all(full[k]["status"] == fast[k]["status"] for k in full)
    by = lambda rows: {s: sum(r["settled"] == s for r in rows.values()) for s in ("key", "form", "bounds", "difflib")}
    assert by(full)["bounds"] == 0 and by(fast)["difflib"] < by(full)["difflib"] and by(fast)["bounds"] > 0
    for k, r in fast.items():
        if r["settled"] == "bounds":
            limit = {f: t for f, kind, t, _ in comparison.ComparisonProfile().rules if kind == "fuzzy"}[k[1]]
            assert r["similarity"] is None and (full[k]["similarity"] >= limit) == (r["status"] == "match") and "score" not in r["explanation"]
        else:
            assert r["similarity"] == full[k]["similarity"] and r["explanation"] == full[k]["explanation"]
        if full[k]["similarity"] is not None and full[k]["strategy"] == "fuzzy":
            assert f"(score={full[k]['similarity']:.3f})" in full[k]["explanation"]
