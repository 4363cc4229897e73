"""Operators 11, 12 and 13 against brute force."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import collocations, hard_negatives, media, queries
from tests.llm.common import corpus, docs

VECTORS = "vec_id long, embedding array<float>, label int, label2 string, i long"


def _vectors(n=240, dims=40, seed=1):
    r = random.Random(seed)
    rows = [(k, [round(r.uniform(-0.6, 0.6), 3) for _ in range(dims)], r.randrange(4), "x", None) for k in range(n)]
    twin = rows[7][1]
    rows += [(n + k, twin, k % 3, None, 1) for k in range(60)]  # one very common vector, ties by id
    rows += [(100, twin, 0, None, 1), (100, twin, 0, None, 1), (200, rows[3][1], 1, None, 2)]  # repeated rows and ids
    rows += [(901, None, 1, None, None), (902, [0.1, None] * 20, 1, None, None), (903, [float("nan")] + [0.1] * 39, 1, None, None), (904, [float("inf")] * 40, 2, None, None)]
    rows += [(905, twin, None, None, None), (None, twin, 1, None, None), (906, [], 1, None, None), (907, twin[:5], 2, None, None), (908, [1e30] * 3, 2, None, None)]
    return rows


def _brute_negatives(rows, anchor_of, low=80, high=100):
    used = [(i, [max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x))))) for x in v], c) for i, v, c, *_ in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    after = lambda i: math.inf if i is None else i
    for at, (i, v, c) in enumerate(used):
        if i is None or not anchor_of(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, d) for k, (j, w, d) in enumerate(used) if k != at]
        best = sorted((x for x in scored if x[2] == c), key=lambda x: (-x[0], after(x[1])))[:5]
        for ps, p, _ in best:
            near = sorted((x for x in scored if x[2] != c and low * ps <= 100 * x[0] <= high * ps), key=lambda x: (-x[0], after(x[1])))[:5]
            out += [(i, p, rank + 1, j, ps, s) for rank, (s, j, _) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [None, (16, 5)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(hard_negatives, "ROWS", blocks[0])
        monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_store_no_scores_and_cut_wide_blocks(spark, monkeypatch):
    """Vectors all alike: every negative of an anchor is near it, and only rows and windows may be stored."""
    import pathlib

    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in 0.5 + r.integers(0, 9, 40) / 256], k % 4, "x", None) for k in range(2000)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    folder = lambda: sum(f.stat().st_size for f in pathlib.Path(spark.sparkContext.getCheckpointDir().replace("file:", "")).rglob("part-*"))
    hard_negatives.hard_negatives(df.limit(1), F.lit(True)).count()
    before = folder()
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.count() == 200 * 25
    assert folder() - before < 3_000_000  # 24 bytes for each anchor and negative would be 7,200,000
    monkeypatch.setattr(hard_negatives, "CELLS", 400)
    monkeypatch.setattr(hard_negatives, "GATHERED", 2)
    small = _vectors()
    got = hard_negatives.hard_negatives(spark.createDataFrame(small, VECTORS).repartition(3), F.col("vec_id") % 20 == 0)
    assert sorted((tuple(x) for x in got.collect()), key=str) == _brute_negatives(small, lambda i: i % 20 == 0)


def test_hard_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame(_vectors(30), VECTORS)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_scores_pass_from_floats_to_integers():
    r = np.random.default_rng(1)
    big = r.integers(-(1 << 26), 1 << 26, (3, 64)).astype(np.int32)
    want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in big] for a in big]
    assert hard_negatives.partial_scores(big, big).tolist() == want
    x = np.array([0, -1, 1, -(1 << 62), (1 << 62) + 5])
    assert hard_negatives.unzigzag(hard_negatives.zigzag(x)).tolist() == x.tolist()


def _brute_collocations(rows, least, top, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[p : p + k])) for k in range(1, longest + 1) for p in range(len(w) - k + 1))
    out = {}
    often = {k: a for k, a in f.items() if a >= least}
    for (lang, w), a in often.items():
        inside = any(b == a and x == lang and len(v) > len(w) and any(v[p : p + len(w)] == w for p in range(len(v))) for (x, v), b in often.items())
        if len(w) > 1 and not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def _texts():
    r = random.Random(5)
    words = ["of", "the", "The", "new", "york", "stock", "é", "a", "日本", "x y"]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k)) + r.choice([".", ",", "\n", " ? ", "\x0b", "\t"])
    rows = [("".join(sentence(r.randint(1, 12)) for _ in range(r.randint(0, 9))), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(t, "en") for _, t in corpus()] + [("new york stock exchange " * 30, "en")] * 3 + [("a a a a a a a a", "de")] * 5
    rows += [(None, None), ("", "fr"), (" .,;", "fr"), (" ".join(["of the new"] * 3000), "en"), ("x" * 5000, "en")]
    return rows


@pytest.mark.parametrize("sizes", [None, (300, 40, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, v in zip(("SHARD_BYTES", "PIECE_BYTES", "BATCH"), sizes):
            monkeypatch.setattr(collocations, name, v)
    rows = _texts()
    df = spark.createDataFrame([(t, c, 1, "k") for t, c in rows], "text string, lang string, s long, ids string").repartition(3)
    for least, top in ((6, 2000), (20, 4)):
        got = collocations.collocations(df, top=top, least=least)
        assert sorted(tuple(r) for r in got.collect()) == _brute_collocations(rows, least, top)


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df).count() == 0


def test_bitmaps_shift_and_and():
    r = np.random.default_rng(3)
    word = r.integers(0, 3, 500)
    position = np.flatnonzero(r.random(900) < 0.6)[:500]
    bits = collocations._of_positions(word[: len(position)], position)
    assert collocations._loaded(collocations._stored(bits, 3), 3).byte.tolist() == bits.byte.tolist()
    index = collocations.Index(bits)
    a, b, children = index.extended(bits.shifted())
    want = Counter((int(word[k]), int(word[k + 1])) for k in range(len(position) - 1) if position[k + 1] == position[k] + 1)
    owners, count = children.popcounts()
    assert {(int(a[o]), int(b[o])): int(c) for o, c in zip(owners, count)} == want


def _plain_landmarks(payload):
    """One file, frame by frame, with whole numbers only."""
    x = [b - 128 for b in payload]
    table = media.TABLE.astype(int)
    frames = [[sum(x[t + k] * int(table[k, c]) for k in range(media.FRAME)) for c in range(media.FRAME)] for t in range(0, len(x) - media.FRAME + 1, media.HOP)]
    half, width = media.FRAME // 2, media.FRAME // 2 // media.BANDS
    power = [[f[c] ** 2 + f[half + c] ** 2 for c in range(half)] for f in frames]
    best = [[max(range(b * width, (b + 1) * width), key=lambda c: (p[c], -c)) for b in range(media.BANDS)] for p in power]
    at = lambda t, b: power[t][best[t][b]]
    peaks = [(t, best[t][b] + 1) for t in range(len(frames)) for b in range(media.BANDS) if at(t, b) > 0 and (t == 0 or at(t, b) > at(t - 1, b)) and (t + 1 == len(frames) or at(t, b) >= at(t + 1, b))]
    out = []
    for t, f in peaks:
        later = [p for p in peaks if p[0] > t][: media.FAN]
        out += [t << 32 | f << 13 | g << 6 | (u - t) for u, g in later if u - t <= media.REACH]
    return out


def test_media_against_plain_transform(spark, monkeypatch):
    monkeypatch.setattr(media, "PIECE", 960)
    rows = [(k, t) for k, (_, t) in enumerate(corpus()) if len(t or "") < 1500]
    df = docs(spark, rows).withColumn("payload", F.lit("own")).withColumn("media", F.lit(1))
    got = media.read_wav(media.as_wav(df)).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == ["doc_id", "text", "lang", "extra", "media", "payload", "landmarks"]
    for r in got:
        raw = (r["text"] or "").encode()
        want = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        with wave.open(io.BytesIO(r["media"])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, want)
        assert r["payload"] == want and r["landmarks"] == _plain_landmarks(want)


def test_media_of_a_very_long_text_nulls_and_no_rows(spark):
    long = "".join(chr(97 + (k * k) % 26) for k in range(3_000_000))
    df = docs(spark, [(1, long), (2, long), (3, None)])
    a, b, c = media.read_wav(media.as_wav(df)).orderBy("doc_id").select("landmarks", F.sha2("payload", 256).alias("h"), F.octet_length("payload").alias("n")).collect()
    assert a["landmarks"] == b["landmarks"] and len(a["landmarks"]) > 1000 and a["landmarks"] == sorted(a["landmarks"], key=lambda x: x >> 32)
    assert a["h"] == hashlib.sha256(media.padded(long.encode())).hexdigest() and (c["n"], c["landmarks"]) == (192, [])
    read = media.read_wav(spark.createDataFrame([(None,), (bytearray(media.to_wav(b"abc" * 100)),)], "media binary"))
    assert sorted((None if r["payload"] is None else bytes(r["payload"]), r["landmarks"] is None) for r in read.collect() if r["payload"]) == [(b"abc" * 100, False)]
    assert read.where("media is null and payload is null and landmarks is null").count() == 1
    assert media.read_wav(media.as_wav(df.limit(0))).count() == 0


def test_media_query_columns(spark, tmp_path):
    rows = corpus()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_media(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = media.padded(raw)
        stored = media.to_wav(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert len(set(by_text.values())) > 20
