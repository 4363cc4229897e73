"""The persisted table of executives: first insert, changes, atomic rewrite; and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXECUTIVES = (
    "subject_id string, name string, title string, company string, email string, phone string, duns_number string, url string, "
    "last_inflection_type string, last_inflection_confidence double, last_inflection_explanation string, last_inflection_detected_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)
_FIELDS = ("name", "title", "company", "email", "phone")


def baseline_insert(stored: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Rows for subjects that are not stored yet.  records: subject_id, the five fields, duns_number, url."""
    fresh = records.join(stored.select("subject_id"), "subject_id", "left_anti").dropDuplicates(["subject_id"])
    none = {"last_inflection_type": "string", "last_inflection_confidence": "double", "last_inflection_explanation": "string", "last_inflection_detected_at": "timestamp"}
    return fresh.select("subject_id", *_FIELDS, "duns_number", "url", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], now.alias("created_at"), now.alias("updated_at"))


def apply_changes(stored: DataFrame, compared: DataFrame, strongest: DataFrame, reported: DataFrame, now: Column) -> DataFrame:
    """stored after an update, and fields_updated.

    compared: ref, field, status, new.  strongest: ref, type, confidence, explanation.  reported: ref of every
    subject with an inflection report, an empty one included (it moves updated_at)."""
    value = F.when(F.col("status").isin("changed", "new"), F.col("new"))
    wide = compared.groupBy(F.col("ref").alias("subject_id")).agg(*[F.max(F.when(F.col("field") == f, value)).alias(f"new_{f}") for f in _FIELDS])
    best = strongest.select(F.col("ref").alias("subject_id"), F.col("type").alias("_type"), F.col("confidence").alias("_confidence"), F.col("explanation").alias("_explanation"))
    told = reported.select(F.col("ref").alias("subject_id")).distinct().withColumn("_told", F.lit(True))
    out = stored.join(wide, "subject_id", "left").join(best, "subject_id", "left").join(told, "subject_id", "left")
    updated = sum((F.col(f"new_{f}").isNotNull().cast("int") for f in _FIELDS), F.lit(0))
    hit = F.col("_type").isNotNull()
    return out.select(
        "subject_id", *[F.coalesce(f"new_{f}", f).alias(f) for f in _FIELDS], "duns_number", "url",
        F.coalesce("_type", "last_inflection_type").alias("last_inflection_type"), F.coalesce("_confidence", "last_inflection_confidence").alias("last_inflection_confidence"),
        F.coalesce("_explanation", "last_inflection_explanation").alias("last_inflection_explanation"), F.when(hit, now).otherwise(F.col("last_inflection_detected_at")).alias("last_inflection_detected_at"),
        "created_at", F.when((updated > 0) | F.coalesce("_told", F.lit(False)), now).otherwise(F.col("updated_at")).alias("updated_at"), updated.alias("fields_updated"),
    )


def rewrite(df: DataFrame, path: str) -> None:
    """Replaces a table by a new version of itself: written beside it first, then moved over by the file system.

    A failure leaves the table as it was, or says where it is: the old version goes only when the new one stands.
    There is a moment without a table between the two moves; `versions.Table` has none, and takes several writers."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside, old = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "._new"), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "._old")
    df.write.mode("overwrite").parquet(beside.toString())
    if fs.exists(old):  # of a run that broke off
        if not fs.exists(target):
            _move(fs, old, target)
        else:
            fs.delete(old, True)
    there = fs.exists(target)
    if there:
        _move(fs, target, old)
    try:
        _move(fs, beside, target)
    except OSError:
        if there:
            _move(fs, old, target)
        raise
    fs.delete(old, True)


def _move(fs, source, target) -> None:
    """A rename that failed is an error, not a value to be overlooked."""
    if not fs.rename(source, target):
        raise OSError(f"could not move {source.toString()} to {target.toString()}")


def latest(history: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key; of equals any whole row is the greatest."""
    others = [c for c in history.columns if c not in key]
    top = history.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at])).alias("x"))
    return top.select(*key, "x.*").select(*history.columns)


def as_of(history: DataFrame, key: list[str], at: str, when: Column) -> DataFrame:
    """The last row of each key not after a moment."""
    return latest(history.where(F.col(at) <= when), key, at)


def history(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """rows with their place in each key's history."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(at, *[c for c in rows.columns if c not in (*key, at)])))


def since(rows: DataFrame, at: str, when: Column, **equal) -> DataFrame:
    """Point filters by column and time: pushed down to the scan."""
    out = rows.where(F.col(at) >= when)
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def edges(relations: DataFrame, node: Column) -> DataFrame:
    """Edges (subject, predicate, object) that touch a node, on either side, once each."""
    return relations.where((F.col("subject") == node) | (F.col("object") == node))
