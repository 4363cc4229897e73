"""Simulated evidence: a stable scenario for each subject, and the observations it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import refdata as R
from dossier.functions import text as X
from dossier.operators.comparison import existing_values
from dossier.operators.inflection import seniority


def bucket(subject: Column, modulo: int) -> Column:
    """The first eight hex digits of the id's SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(subject, 256), 1, 8), 16, 10).cast("long") % modulo


def scenario(subject: Column) -> Column:
    """Weighted pick by the bucket."""
    out, upto = None, 0
    for name, weight in R.SCENARIOS:
        upto += weight
        out = (F if out is None else out).when(bucket(subject, sum(w for _, w in R.SCENARIOS)) < upto, name)
    return out.otherwise(R.SCENARIOS[-1][0])


def promoted_titles(subjects: DataFrame, ref: str, title: str, threshold: float = 0.80) -> DataFrame:
    """ref, promoted: the first rung that reads differently and ranks higher (any rung, where the title has no rank)."""
    rungs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(R.LADDER)])
    rows = subjects.select(F.col(ref).alias("ref"), F.col(title).alias("title"), F.explode(rungs).alias("x")).select("ref", "title", "x.k", "x.t")
    known = F.coalesce(F.col("title"), F.lit("")) != ""
    likeness = X.sequence_ratio(X.collapse(F.col("t")), X.collapse(F.coalesce(F.col("title"), F.lit(""))))
    old, new = seniority(F.col("title")), seniority(F.col("t"))
    fits = F.when(known, (likeness < threshold) & (old.isNull() | (new > old))).otherwise(F.col("k") == len(R.LADDER) - 1)
    return rows.groupBy("ref").agg(F.min(F.when(fits, F.struct("k", "t")))["t"].alias("promoted"))


def observations(records: DataFrame, ref: str) -> DataFrame:
    """subject_id, attribute, value, provider_id, scenario of every subject.  A title or company comes with the name."""
    values = existing_values(records, ref).groupBy("ref").pivot("field", ["name", "title", "company", "email", "phone"]).agg(F.max("existing"))
    up = promoted_titles(values, "ref", "title")
    rows = values.join(up, "ref").withColumn("scenario", scenario(F.col("ref").cast("string")))
    acquirer = F.element_at(F.array(*[F.lit(a) for a in R.ACQUIRERS]), (bucket(F.col("ref").cast("string"), len(R.ACQUIRERS)) + 1).cast("int"))
    mail = F.coalesce("email", F.lit("person@example.com"))
    domain = F.regexp_extract(mail, "^[^@]*@(.*)$", 1)
    moved = F.concat(F.regexp_extract(mail, "^[^@]*", 0), F.lit(".new@"), F.when(domain != "", domain).otherwise("example.com"))
    new = {"promotion": ("title", F.col("promoted")), "company_change": ("company_name", acquirer), "contact_change": ("email", moved), "confirmed": ("title", F.col("title"))}
    items = []
    for k, (s, (attribute, value)) in enumerate(new.items()):
        on = (F.col("scenario") == s) & value.isNotNull()
        items.append(F.when(on, F.struct(F.lit(attribute).alias("attribute"), value.alias("value"))))
        if s != "contact_change":
            items.append(F.when(on & F.col("name").isNotNull(), F.struct(F.lit("full_name").alias("attribute"), F.col("name").alias("value"))))
    out = rows.select(F.col("ref").alias("subject_id"), "scenario", F.explode(F.array(*items)).alias("x")).where("x is not null")
    return out.select("subject_id", "x.attribute", "x.value", F.lit("simulated_evidence").alias("provider_id"), "scenario")


def summary(records: DataFrame, ref: str, found: DataFrame) -> DataFrame:
    """Subjects and observations by scenario."""
    s = records.select(F.col(ref).alias("subject_id"), scenario(F.col(ref).cast("string")).alias("scenario"))
    n = found.groupBy("scenario").agg(F.count("*").alias("observations"))
    return s.groupBy("scenario").agg(F.count("*").alias("subjects")).join(F.broadcast(n), "scenario", "left").na.fill(0, ["observations"])  # five rows
