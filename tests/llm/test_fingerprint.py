"""Operator 4 against brute force."""

import hashlib
import struct

import pytest
import xxhash

from dossier.llm import fingerprint
from tests.llm.common import corpus, docs, prose


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_edited_texts_and_likeness(spark):
    rows = [(k, prose(400 + k, k, 300)) for k in range(40)] + [(100, None), (101, ""), (102, "one"), (103, "one"), (104, prose(300, 9)), (105, prose(300, 9)), (106, "é🙂 " * 50), (None, "first of all")]
    out = {r["doc_id"]: r for r in fingerprint.compare_edited(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    off = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest(), i
        assert len(r["fingerprint"]) == fingerprint.BINS * fingerprint.BITS // 4
        for got, a, b in ((r["near_edited"], t, new), (r["near_next"], t, following)):
            assert 0 <= got <= 1
            off.append(abs(got - jaccard(a, b)))
            if a == b:
                assert got == 1
    assert max(off) < 0.3 and sum(off) / len(off) < 0.05
    assert out[102]["fingerprint"] == out[103]["fingerprint"] and out[104]["near_next"] == 1.0
    assert out[100]["fingerprint"] == out[101]["fingerprint"]


def test_repeated_rows_one_row_and_no_row(spark):
    rows = corpus()
    out = fingerprint.compare_edited(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (60, 13)}) == 1
    one = fingerprint.compare_edited(docs(spark, [(5, "a b c d e f g")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.compare_edited(docs(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprint.compare_edited(docs(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain(text):
    """One-permutation MinHash word by word."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in (text or "").replace("\x1c", " ").split()]
    bins = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64(struct.pack("<Q", w), seed=h).intdigest()
        b = (signed(h) >> 57) + 64
        bins[b] = min(bins.get(b, 1 << 64), h & 0xFFFFFFFFFFFFFFFF)
    order = fingerprint._order()
    return "".join(f"{bins[next(j for j in [i] + [i ^ m for m in order] if j in bins)] & 255:02x}" for i in range(128))


def test_fingerprint_is_the_plain_one(spark):
    rows = [*corpus(), (200, " lead and trail \n"), (201, "a b c d"), (202, "a b c d e"), (203, prose(2500, 4, 900))]
    out = fingerprint.compare_edited(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.append((i, plain(t), plain(t[: len(t) - q] + following[:q])))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fingerprint"], r["edited_fingerprint"])) for r in out)
    named = docs(spark, rows).withColumnsRenamed({"extra": "_row", "lang": "_text"})
    again = fingerprint.fingerprints(named.withColumnRenamed("doc_id", "_o__bits"))
    assert again.columns == ["_o__bits", "text", "_text", "_row", "fingerprint"]
    assert sorted(map(str, ((r["_o__bits"], r["fingerprint"]) for r in again.collect()))) == sorted(map(str, ((i, p) for i, p, _ in want)))


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        fingerprint.compare_edited(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
