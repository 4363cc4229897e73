"""Operators 1, 2, 5, 7 and 9 against brute force."""

import random
import re
import zlib

import pytest

from dossier.llm import bpe, decontaminate, licenses, queries, shard, toxicity
from tests.llm.common import corpus, docs, prose


def test_bpe_is_tiktoken_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    ranks, pattern = queries.tokenizer(spark)
    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus() + [(70, "".join(random.Random(3).choices("aab bcé\n\t🙂<|>'sZ9", k=5000)))]
    out = bpe.encode_decode(docs(spark, rows), ranks, pattern).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = [int.from_bytes(r["token_ids"][i : i + 4], "little") for i in range(0, len(r["token_ids"]), 4)]
        assert ids == peer.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_long_piece_takes_little_time(spark):
    ranks, _ = queries.tokenizer(spark)
    assert len(bpe.encode_piece(b"ab" * 20_000, ranks)) > 1000


def test_bpe_merges_words_without_a_tree_and_alike(spark, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    ranks, _ = queries.tokenizer(spark)
    peer, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(5)
    pieces = ["".join(rng.choices("aabeinst", k=n)) for n in [*range(1, 132), *[rng.randint(2, 30) for _ in range(500)]]]
    for piece in ("aaaa" * 32, "aaaaa" * 30, *pieces):
        raw = piece.encode()
        ids = bpe.encode_piece(raw, ranks)
        assert ids == peer.encode_ordinary(piece)
        if raw not in ranks:
            assert ids == bpe.merge_short(raw, ranks) == bpe.merge_long(raw, ranks)
    monkeypatch.setattr(bpe, "SegmentTree", None)
    assert len(bpe.encode_piece(b"qzxwvkjq" * 3, ranks)) > 3


def test_bpe_empty_table(spark):
    ranks, pattern = queries.tokenizer(spark)
    assert bpe.encode_decode(docs(spark, corpus()).limit(0), ranks, pattern).count() == 0


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contaminated(text, items):
    w, hit, found = _words(text), set(), set()
    for item, body in items:
        b = _words(body)
        for i in range(max(1, len(b) - 9) if b else 0):
            x = b[i : i + 10]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [None, 200])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    base = corpus()
    by = dict(base)
    items = [(1, by[10][:200].upper()), (2, "one, two? three"), (3, None), (4, ""), (5, " ".join(by[51].split()[100:130])), (None, by[11][50:300]), (7, "one"), (10, "one"), (8, prose(15, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs(spark, base), bench).withColumn("n_hit", decontaminate.n_hit()).collect()
    assert len(out) == len(base)
    for r in out:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == _contaminated(r["text"], items), r["doc_id"]


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(docs(spark, corpus()), bench).collect()
    assert all(r["hit_spans"] == [] and r["item_ids"] == [] for r in out) and len(out) == len(corpus())
    kept = decontaminate.remove_contaminated(docs(spark, corpus()), bench)
    assert kept.columns == ["doc_id", "text", "lang", "extra"] and kept.count() == len(corpus())


def test_shards_are_contiguous_and_even(spark):
    rows = corpus()
    out = shard.contiguous_shards(docs(spark, rows), 7).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    largest = max(r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for s, own in by.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= largest
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    text = {i: t for i, t in rows}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] is not None)
    assert shard.contiguous_shards(docs(spark, rows).limit(0), 7).count() == 0


def _toxic(seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        sentences = [prose(12, seed * 1000 + i * 7 + k, 200) for k in range(r.randint(1, 8))]
        y = int(r.random() < 0.3)
        if y:
            k = r.randrange(len(sentences))
            sentences[k] = sentences[k][:20] + " awful wretch " + sentences[k][20:]
        rows.append((i, ". ".join(sentences)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_finds_held_out_documents_and_their_sentences(spark):
    rows, labels = _toxic(1)
    table = docs(spark, [*rows, (9000, None), (9001, ""), (None, "awful wretch")])
    model = toxicity.train(table, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"), ~toxicity.held_out())
    out = {r["doc_id"]: r for r in toxicity.toxicity(table, model).withColumn("h", toxicity.held_out()).collect()}
    truth = dict(labels)
    held = [i for i in truth if out[i]["h"]]
    assert len(held) > 40 and all(out[i]["h"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    right = sum((out[i]["score"] >= 0.5) == bool(truth[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert out[9000]["score"] == out[9001]["score"] < 0.5 <= out[None]["score"]
    for i in held:
        if truth[i] and out[i]["score"] >= 0.5:
            assert any("wretch" in out[i]["text"].encode()[s["start"] : s["end"]].decode() for s in out[i]["toxic_sentences"])
    kept = toxicity.remove_toxic(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == table.columns and kept.count() < len(rows)


def test_toxicity_does_not_grow_with_length(spark):
    rows, labels = _toxic(1)
    clean = ". ".join(prose(12, 70_000 + k, 200) for k in range(400))
    table = docs(spark, [*rows, (9000, "\n".join([clean] * 150)), (9001, clean + ". you awful wretch")])
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.toxicity(table.where("doc_id >= 9000"), model).collect()}
    assert len(out[9000]["text"]) > 2_000_000 and out[9000]["score"] < 0.5 and out[9000]["toxic_sentences"] == []
    assert out[9001]["score"] >= 0.5


def test_toxicity_learns_from_long_documents(spark):
    rows, labels = _toxic(1)
    pad = ". ".join(prose(12, 80_000 + k, 200) for k in range(700))
    rows = [(i, pad + ". " + t) for i, t in rows[:200]]
    assert min(len(t) for _, t in rows) > 32_768
    table = docs(spark, rows)
    out = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.toxicity(table, toxicity.train(table, spark.createDataFrame(labels[:200], "doc_id long, toxic int"), ~toxicity.held_out())).where(toxicity.held_out()).collect()}
    assert any(out.values()) and sum(out[i] == bool(y) for i, y in labels[:200] if i in out) >= 0.97 * len(out)


def test_toxicity_without_labels_or_with_one_class(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    table = docs(spark, corpus())
    assert toxicity.toxicity(table, toxicity.train(table, none)).where("score >= 0.5").count() == 0
    one = spark.createDataFrame([(10, 0), (11, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(table, toxicity.train(table, one)).where("score >= 0.5").count() == 0


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (2, mit.upper().replace("\n\n", "\n")), (3, "MIT Licence\nCopyright (c) 2020 Someone\n" + mit.split("\n", 1)[1].replace(",", " ,")), (4, mit + " extra"), (5, None), (6, ""), (7, licenses.KNOWN["ISC"]), (1, mit)]
    out = licenses.license_scan(docs(spark, rows)).collect()
    got = sorted((r["doc_id"], r["license_id"] or "") for r in out)
    assert got == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, ""), (5, ""), (6, ""), (7, "ISC")]
    assert licenses.license_scan(docs(spark, rows).limit(0)).count() == 0
    known = licenses.known_texts()
    assert {r["_license"] for r in licenses.known_digests(spark).collect()} == set(licenses.KNOWN) and licenses.known_digests(spark).count() >= len(known) - 3
    # Every text under every title, in other spelling, is found; with a word more it is not.
    spelt = lambda x: "Copyright (c) 1999, A. Body\n" + x.upper().replace("LICENSE", "Licence").replace(",", " ;").replace("\n\n", "\n \n")
    rows = [(k, spelt(body)) for k, (_, body) in enumerate(known)] + [(1000 + k, body + " more") for k, (_, body) in enumerate(known)]
    found = licenses.license_scan(docs(spark, rows).withColumnsRenamed({"lang": "_canonical", "extra": "_digest"}))
    assert found.columns == ["doc_id", "text", "_canonical", "_digest", "canonical_chars", "canonical_sha256", "license_id"]
    got = {r["doc_id"]: r["license_id"] for r in found.collect()}
    assert all(got[k] == name and got[1000 + k] is None for k, (name, _) in enumerate(known))
    own = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs(spark, [(1, "My own, words"), (2, "other")]), known={"own": "my OWN words!"}).collect()}
    assert own == {1: "own", 2: None}


def test_several_blocks_and_columns_of_any_name(spark, monkeypatch):
    rows = corpus()
    bench = spark.createDataFrame([(k, " ".join(t.split()[:30])) for k, t in rows if t and len(t.split()) > 30][:8], "item_id long, text string")
    one = decontaminate.contamination(docs(spark, rows), bench)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    odd = docs(spark, rows).withColumnsRenamed({"lang": "_a", "extra": "_b"})
    several = decontaminate.contamination(odd, bench)
    assert several.columns == ["doc_id", "text", "_a", "_b", "n_words", "hit_spans", "item_ids"]
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["n_words"], str(r["hit_spans"]), str(r["item_ids"]))
    assert sorted(map(key, several.collect())) == sorted(map(key, one.collect()))


def test_an_id_with_many_texts_is_learnt_from_once(spark):
    table = docs(spark, [(1, f"text {k} vile") for k in range(50)] + [(k, "calm") for k in range(2, 20)])
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 20)], "doc_id long, toxic int")
    assert toxicity.train(table, labels) is not None
    out = toxicity.toxicity(table, toxicity.train(table, labels))
    assert out.count() == 68
