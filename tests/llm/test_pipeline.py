"""The corpus pipeline: every stage acts, keeps clean documents, and bears any table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import bpe, jaccard_join, queries, suffix_dedup, toxicity
from tests.llm.common import corpus, prose


def fixture(spark, folder, rows, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, n_words string"
    spark.createDataFrame([(i, t, "en", None, len(t or ""), "r", "w") for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_act_and_clean_documents_stay(spark, tmp_path):
    rows, labels = [], []
    for k in range(240):  # labelled prose, every sixth with a toxic sentence
        text = ". ".join(prose(10, 10_000 + 13 * k + j, 400) for j in range(5))
        if k % 6 == 0:
            text += ". you awful wretched clown"
        rows.append((k, text))
        labels.append((k, 1, int(k % 6 == 0)))
    near = prose(200, 1, 500)
    rows += [(1000, near), (1001, near), (1002, near.replace(near.split()[50], "edited", 1))]
    passage = prose(70, 2, 500)
    rows += [(1010, prose(40, 3, 500) + " " + passage), (1011, passage + " " + prose(40, 4, 500))]
    leak = prose(30, 5, 500)
    rows += [(1020, prose(60, 6, 500) + " " + leak + " " + prose(20, 7, 500)), (1030, None), (1031, ""), (None, prose(50, 8, 500))]
    fixture(spark, str(tmp_path), rows, labels, [(1, leak)])
    docs = queries.table(spark, str(tmp_path), "documents")
    seen = {None: {r["doc_id"] for r in docs.collect()}}
    columns = docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"]: r for r in docs.collect()}
        seen[name] = set(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {k for k in range(0, 240, 6)}
            assert len(toxic & set(now)) <= 2 and len(set(range(240)) - toxic - set(now)) <= 2
        if name == "ngram_jaccard_join":
            assert {1000, 1001, 1002} & set(now) == {1000} and len(seen["toxicity"]) - len(now) == 2
        if name == "suffix_array_dedup":
            assert set(now) == before and passage[60:200] not in now[1010]["text"] and passage[60:200] not in now[1011]["text"]
            assert now[1030]["text"] is None and now[1]["text"] == dict(rows)[1]
        if name == "decontamination":
            assert before - set(now) == {1020}
        before = set(now)
    assert {"token_ids"} == set(docs.columns) - set(columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(before)


def test_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_tables(spark, tmp_path):
    rows = corpus()
    fixture(spark, str(tmp_path), rows, [(None, 1, 1), (10, None, None)], [(None, None), (2, "")])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) < len(rows)


def test_last_stage_decodes_and_holds_the_text_against_it(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one Two  三\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.tokens(spark, docs, "").collect()} == {1, 2, 3}
    real = bpe.encode_decode

    def wrong(*args, decoded, **named):
        assert decoded
        return real(*args, decoded=decoded, **named).withColumn(decoded, F.lit(b"other"))

    monkeypatch.setattr(bpe, "encode_decode", wrong)
    with pytest.raises(Exception, match="round trip"):
        corpus_pipeline.tokens(spark, docs, "").collect()


def test_defaults():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "decontamination", "bpe"]
    assert suffix_dedup.LENGTH == 200 and jaccard_join.keep_one.__defaults__[:2] == ("0.8", 5) and toxicity.TRAIN_ROWS <= 10_000
