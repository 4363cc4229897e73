"""A corpus pipeline of the operators in dossier.llm: toxic documents go, one document of each group of
near copies stays, repeated passages are cut, contaminated documents go, and the rest is tokenized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, decontaminate, jaccard_join, queries, suffix_dedup, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, queries.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids; they are decoded again, and the run fails where that does not give the text."""
    ranks, pattern = queries.tokenizer(spark)
    out = bpe.encode_decode(docs, ranks, pattern, decoded="_decoded")
    same = F.col("_decoded").eqNullSafe(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the round trip of a text failed")).cast("boolean"))).drop("_decoded")


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_copies), ("suffix_array_dedup", repeated_passages), ("decontamination", decontamination), ("bpe", tokens)]
#: Trained weights, suffix sorting and tokenization are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
