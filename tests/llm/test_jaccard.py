"""Operator 8 against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import jaccard_join
from tests.llm.common import corpus, docs, prose


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((str(rows[i][0]), len(sets[i]), str(least.get(find(i)))) for i in range(len(rows))))


def many(seed=0):
    r = random.Random(seed)
    rows = corpus()
    k = 1000
    for g in range(25):
        words = prose(r.choice([4, 9, 12, 25, 60, 150]), 700 + g, 300).split()
        for _ in range(r.randint(1, 9)):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                p = r.randrange(len(w))
                w[p : p + r.choice([0, 1])] = [r.choice(["new", "other", "Word"])]
            rows.append((k, " ".join(w)))
            k += r.randint(1, 5)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold,n,block", [("0.9", 3, 4000), ("0.9", 3, 3), ("0.8", 5, 4000), ("0.5", 2, 4000)])
def test_against_brute_force(spark, monkeypatch, threshold, n, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = many()
    t = Fraction(threshold)
    out = jaccard_join.jaccard_components(docs(spark, rows), threshold, n).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute(rows, n, t.numerator, t.denominator)


@pytest.mark.parametrize("block", [4000, 4])
def test_words_that_all_documents_share(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = [prose(40, i) for i in range(12)]
    short = [f"the same start {w}" for w in ("here", "there", "now")]  # their rarest shingles are shared by all
    rows = list(enumerate([f"the same start {t} the same end" for t in texts * 2] + short * 2 + ["the same start"] * 3))
    out = jaccard_join.jaccard_components(docs(spark, rows), "0.9", 3).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute(rows, 3, 9, 10)


def test_groups_are_not_closed_over_others(spark):
    """A chain of sets, each sharing a token with the next: every group holds a leader and its neighbours only."""
    chain = [(a, np.array([a, a + 1], np.int64).tobytes()) for a in range(50)]
    groups = jaccard_join._groups(spark.createDataFrame(chain, "_a long, _tokens binary")).collect()
    assert sorted((r["_block"], r["_a"]) for r in groups) == sorted([(a, a) for a in range(49)] + [(a, a + 1) for a in range(49)])


def test_search_equals_counting():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(300) < 0.95], r.integers(0, 1 << 60, r.integers(0, 30)).astype(np.uint64)])) for _ in range(60)]
    lists = jaccard_join.Lists(sets)
    for q in range(60):
        got = set(lists.search(q, np.ones(60, bool), Fraction(4, 5)).tolist())
        want = {j for j in range(60) if 5 * len(np.intersect1d(sets[q], sets[j])) >= 4 * len(np.union1d(sets[q], sets[j]))}
        assert got == want


def test_one_of_each_group_stays(spark):
    rows = many(3)
    table = docs(spark, rows).withColumn("n_shingles", F.lit(0))
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((str(a), str(b)) for a, b in got if a == 60) == [("60", str(dict(rows)[60]))] or not any(a == 60 for a, _ in got)
    groups = brute(rows, 5, 4, 5)
    empty = sum(not (t or "").split() for _, t in rows)
    assert len(got) == len({c for _, n, c in groups if n}) + empty
    assert jaccard_join.keep_one(table.limit(0)).count() == 0


def test_of_rows_alike_the_least_stays(spark):
    rows = [(7, "one two three four five six", "b"), (7, "one two three four five six", "a"), (8, "", "z"), (8, "", "y")]
    for parts in (1, 3):
        out = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _b string").repartition(parts)).collect()
        first = {r["doc_id"]: r["_b"] for r in out} if parts == 1 else first
        assert len(out) == 2 and {r["doc_id"]: r["_b"] for r in out} == first
