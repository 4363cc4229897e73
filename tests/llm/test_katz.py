"""Operator 6 against a plain Katz model."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.llm import katz
from tests.llm.common import corpus, docs, prose


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain(rows, train):
    uni, bi, ctx = Counter(), Counter(), Counter()
    for (_, t), use in zip(rows, train):
        if use:
            last = "<start>", 0
            for w in tokens(t):
                uni[w] += 1
                bi[last, w] += 1
                ctx[last] += 1
                last = w
    N, V = sum(uni.values()), len(uni)
    d1 = katz.discounts([sum(c == r for c in uni.values()) for r in range(1, 7)])
    d2 = katz.discounts([sum(c == r for c in bi.values()) for r in range(1, 7)])
    disc = lambda d, c: (d[c] if c <= 5 else 1.0) * c
    raw = {w: disc(d1, c) / N for w, c in uni.items()}
    scale = 1.0
    if N and sum(raw.values()) >= 1 - 1e-15:
        scale = N / (N + 1)
    p1 = {w: scale * x for w, x in raw.items()}
    unknown = 1 - sum(p1.values()) if N else 1.0
    followers = {}
    for (h, w), c in bi.items():
        followers.setdefault(h, {})[w] = c

    def p(w, h):
        back = p1.get(w, unknown)
        if not ctx[h]:
            return back
        seen = {x: disc(d2, c) / ctx[h] for x, c in followers[h].items()}
        left = sum(c - disc(d2, c) for c in followers[h].values()) / ctx[h]
        if left <= 0:
            seen = {x: y * ctx[h] / (ctx[h] + 1) for x, y in seen.items()}
            left = 1 / (ctx[h] + 1)
        return seen.get(w) or left / (1 - sum(p1[x] for x in seen)) * back

    out = []
    for (i, t), use in zip(rows, train):
        total, base, known, last = 0.0, 0.0, 0, ("<start>", 0)
        for w in tokens(t):
            total += math.log10(p(w, last))
            base += math.log10((uni[w] + 0.5) / (N + 0.5 * (V + 1)))
            known += uni[w] > 0
            last = w
        out.append((str(i), t or "", use, len(tokens(t)), known, N, base, total))
    return out, p, list(uni), list(followers)


def run(table, train):
    joined = katz.score(table.withColumn("text2", F.col("text")), train)
    return joined.collect()


@pytest.mark.parametrize("spread,rows", [(500_000, corpus()), (3, corpus(5) + [(500 + k, prose(200, 900, 30)) for k in range(5)])])
def test_scores_and_normalisation(spark, monkeypatch, spread, rows):
    monkeypatch.setattr(katz, "SPREAD", spread)
    use = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    got = sorted((str(r["doc_id"]), r["_train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs(spark, rows), train).collect())
    want, p, words, contexts = plain(rows, use)
    want = sorted((i, u, n, k, N, round(b, 6), round(s, 6)) for i, _, u, n, k, N, b, s in want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5) and a[6] == pytest.approx(b[6], abs=1e-5)
    assert len(got) == len(want)
    for h in contexts[:5] + contexts[-5:]:
        assert sum(p(w, h) for w in [*words, "never seen"]) == pytest.approx(1)


def test_nothing_to_learn_from_and_no_rows(spark):
    out = katz.score(docs(spark, corpus()), F.lit(False)).collect()
    assert len(out) == len(corpus()) and all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in out)
    assert katz.score(docs(spark, corpus()).limit(0), F.lit(True)).count() == 0
