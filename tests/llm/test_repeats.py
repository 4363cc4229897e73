"""Operators 3 and 10 against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import suffix_dedup, suffix_tree_dedup
from dossier.llm._text import BYTE_CODE
from tests.llm.common import corpus, docs, prose


def brute_bytes(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def brute_words(rows, window):
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            at = (-(1 << 63) if i is None else i, p)
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, at), at)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (-(1 << 63) if i is None else i, p):
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def more():
    rows = corpus()
    passage = prose(45, 77)
    for k in range(12):
        rows.append((100 + k, prose(10 + k, 500 + k) + " " + passage[k * 3 :] + " " + prose(9, 600 + k)))
    rows += [(200, passage), (201, passage[5:]), (202, passage[:-5]), (203, passage + " " + passage), (204, ("spam eggs ham. " * 60)), (205, "ham. " + "spam eggs ham. " * 20)]
    return rows


@pytest.mark.parametrize("length,anchor,q,hot", [(200, 48, 16, None), (200, 48, 16, 2), (200, 48, 100, None), (64, 16, 20, None), (50, 12, 7, 3)])
def test_bytes_against_brute_force(spark, length, anchor, q, hot):
    rows = more()
    out = suffix_dedup.dedup_substrings(docs(spark, rows), length, hot=hot, anchor=anchor, q=q).collect()
    key = lambda x: (str(x[0]), str(x[1]), x[2:])
    got = sorted(((r["doc_id"], r["text"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed_spans"]), len(r["removed_spans"]), bytes(r["kept_bytes"])) for r in out), key=key)
    want = sorted(((*row, *x) for row, x in zip(rows, brute_bytes(rows, length))), key=key)
    assert got == want


@pytest.mark.parametrize("window,gram,hot", [(20, 5, None), (20, 5, 2), (7, 3, 3), (3, 3, None)])
def test_words_against_brute_force(spark, window, gram, hot):
    rows = more()
    out = suffix_tree_dedup.dedup_passages(docs(spark, rows), window, gram, hot=hot).collect()
    key = lambda x: (str(x[0]), str(x[1]), x[2:])
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out), key=key)
    want = sorted(((*row, *x) for row, x in zip(rows, brute_words(rows, window))), key=key)
    assert got == want


def test_refinement_rounds_agree():
    text = np.frombuffer((prose(300, 5, 9) * 2).encode(), np.uint8)
    suffixes = np.arange(len(text) - 40)
    same = lambda q: np.unique(suffix_dedup.classes(BYTE_CODE[text], suffixes, 40, q), return_inverse=True)[1]
    pairs = lambda q: same(q)[:, None] == same(q)[None, :]
    want = np.array([[(text[i : i + 40] == text[j : j + 40]).all() for j in suffixes] for i in suffixes])
    for q in (3, 7, 10, 20, 39):
        assert (pairs(q) == want).all()


def test_empty_table_and_other_columns(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, corpus()).limit(0)).count() == 0
    assert suffix_tree_dedup.dedup_passages(docs(spark, corpus()).limit(0)).count() == 0
    table = docs(spark, corpus()).withColumn("n_bytes", F.lit(1)).withColumn("kept_text", F.lit("z"))
    assert suffix_dedup.dedup_substrings(table).columns == ["doc_id", "text", "lang", "extra", "kept_text", "n_bytes", "removed_spans", "kept_bytes"]
    cut = suffix_dedup.cut_repeats(table)
    assert cut.columns == table.columns and cut.where("text is null").count() == 2 and cut.count() == len(corpus())


def test_refined_pointers_are_read_by_later_rounds():
    codes = BYTE_CODE[np.frombuffer(b"spam eggs " * 60, np.uint8)]
    found = suffix_dedup.buckets(codes, np.arange(len(codes) - suffix_dedup.LENGTH + 1), suffix_dedup.LENGTH)
    assert found.rounds == 4  # 16, 32, 64, 128, 200
    assert len(np.unique(found.pointer[:400])) == 10


def test_columns_of_any_name_pass_through(spark):
    rows = more()
    for call, own in ((suffix_dedup.dedup_substrings, "kept_bytes"), (suffix_tree_dedup.dedup_passages, "kept_text")):
        plain = call(docs(spark, rows)).select("text", own).collect()
        for a, b in (("_runs", "_d"), ("_v", "_row"), ("_key", "_text"), ("_kept", own)):
            odd = docs(spark, rows).withColumnsRenamed({"lang": a, "extra": b})
            out = call(odd)
            assert out.columns[:3] == ["doc_id", "text", a] and out.where(f"`{a}` = 'en'").count() > 0
            assert sorted(map(str, out.select("text", own).collect())) == sorted(map(str, plain))
        with pytest.raises(TypeError):
            call(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
