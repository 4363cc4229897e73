"""The circuit breaker and activity windows over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators import versions
from dossier.operators.providers import UNHEALTHY

OUT = "provider_id long, seq long, consecutive_failures int, status string"
#: A provider's attempts of one batch are cut into so many ranges of seq, each a task's group of its own.
RANGES = 64
#: After so many batches the breakers' state is made whole.
COMPACT_EVERY = 20


def breaker(attempts: DataFrame, threshold: int = UNHEALTHY) -> DataFrame:
    """attempts (provider_id, seq, ok) of a stream: the provider's state after each attempt of a batch.

    State is one number a provider.  Attempts of one batch are taken in order of seq, which holds a provider's whole batch in
    memory: for small batches that go on to further streaming operators.  `run_breaker` has no such bound."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")  # one provider's attempts since the last batch
        failed = ~rows["ok"].to_numpy(bool)
        total = np.cumsum(failed)
        base = np.maximum.accumulate(np.where(failed, -streak, total))  # failures before the last success
        streaks = total - base
        state.update((int(streaks[-1]),))
        status = np.select([streaks >= threshold, streaks > 0], ["unhealthy", "degraded"], "healthy")
        yield pd.DataFrame({"provider_id": rows["provider_id"], "seq": rows["seq"], "consecutive_failures": streaks, "status": status})

    return attempts.groupBy("provider_id").applyInPandasWithState(fold, OUT, "streak int", "append", GroupStateTimeout.NoTimeout)


def streaks(attempts: DataFrame, carried: DataFrame, ranges: int = RANGES) -> DataFrame:
    """attempts (provider_id, seq, ok) plus consecutive_failures, going on from carried (provider_id, streak; one row each).

    A provider with a third of all attempts is `ranges` groups, not one: a range of seq knows its streaks, whether it held a
    success, and its last streak; a table of a row a provider and range carries them over.  Of equal seq failures stand
    first; an attempt with no outcome is a failure."""
    ends = attempts.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    first, width = (ends["a"] or 0), ((ends["b"] or 0) - (ends["a"] or 0)) // ranges + 1
    ok = F.coalesce("ok", F.lit(False))
    rows = attempts.withColumns({"ok": ok, "range": F.expr(f"(seq - {first}) div {width}")})

    run = Window.partitionBy("provider_id", "range").orderBy("seq", "ok").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_failures", F.sum((~F.col("ok")).cast("long")).over(run))
    rows = rows.withColumn("_before", F.max(F.when(F.col("ok"), F.col("_failures"))).over(run))  # failures up to the last success
    rows = rows.withColumn("_streak", F.col("_failures") - F.coalesce("_before", F.lit(0)))

    # The same once more, over ranges: a range with a success starts anew, another adds its failures.
    table = rows.groupBy("provider_id", "range").agg(F.bool_or("ok").alias("fresh"), F.max_by("_streak", F.struct("seq", "ok", "_failures")).alias("last"))
    table = table.join(carried.select("provider_id", F.col("streak").alias("start")), "provider_id", "left").withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))
    over = Window.partitionBy("provider_id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("total", F.sum("last").over(over))
    table = table.withColumn("before", F.max(F.when(F.col("fresh"), F.col("total") - F.col("last"))).over(over))
    table = table.withColumn("open", F.col("total") - F.coalesce("before", -F.col("start")))
    table = table.select("provider_id", "range", F.coalesce(F.lag("open").over(Window.partitionBy("provider_id").orderBy("range")), "start").alias("carried"))

    out = rows.join(table, [rows["provider_id"].eqNullSafe(table["provider_id"]), rows["range"] == table["range"]]).drop(table["provider_id"], table["range"])
    value = F.col("_streak") + F.when(F.col("_before").isNull(), F.col("carried")).otherwise(0)
    return out.select(*attempts.columns, value.cast("int").alias("consecutive_failures"))


def run_breaker(attempts: DataFrame, folder: str, threshold: int = UNHEALTHY, ranges: int = RANGES, **trigger) -> DataFrame:
    """Runs a stream of attempts (provider_id, seq, ok) until it is read up; returns what has come out so far, as `OUT`.

    Everything lives in `folder`, which all executors share: the stream's checkpoint, rows by batch, and the breakers' state, one
    number a provider, as a table in versions.  A batch writes its rows, then commits its state under its number.  One that
    broke off before that is done again over its own rows; one that broke off after it is passed over; so every attempt
    comes out once, and a reader takes no batch without its state.  Batches follow each other as they arrive: an attempt that
    is late counts after those of earlier batches.

    A stateful Python operator would get a provider's attempts of a batch in no order and have to hold them to sort
    them; here Spark's windows sort, and spill."""
    spark = attempts.sparkSession
    state = versions.Table(spark, f"{folder}/state", ["provider_id"])
    attempts = attempts.select("provider_id", "seq", "ok")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        log = state.entries()
        if number <= _last_batch(log):
            return
        carried = state.read() if log else own.createDataFrame([], "provider_id long, streak long")
        streaked = streaks(batch, carried, ranges)
        n = F.col("consecutive_failures")
        status = F.when(n >= threshold, "unhealthy").when(n > 0, "degraded").otherwise("healthy")
        streaked.select("provider_id", "seq", "consecutive_failures", status.alias("status"), "ok").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        written = own.read.parquet(f"{folder}/rows/batch={number}")
        last = written.groupBy("provider_id").agg(F.max_by(n, F.struct("seq", "ok", n)).cast("long").alias("streak"))
        base = log[-1].number if log else 0
        state.commit(last, base, note=str(number))
        whole = max((e.number for e in log if e.kind != versions.CHANGES), default=0)
        if base + 1 - whole >= COMPACT_EVERY:
            state.compact()

    run = attempts.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    run.awaitTermination()
    return breaker_rows(spark, folder)


def breaker_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches whose state is committed."""
    last = _last_batch(versions.Table(spark, f"{folder}/state", ["provider_id"]).entries())
    if last < 0:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/rows").where(F.col("batch") <= last).drop("batch")


def _last_batch(log: list[versions.Entry]) -> int:
    return max((int(e.note) for e in log if e.note is not None), default=-1)


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and failures by tumbling window and user, late data within the watermark.

    In append mode a window comes out once the watermark (the latest time less `late`) has passed its end; those
    that are still open then come with later events."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "user_id")
    return w.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failures")).select(F.col("window.start").alias("start"), "user_id", "events", "failures")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the streaming engine, as a table in the driver's memory: for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that is there now, through the streaming engine, appended to Parquet files; a second run goes on where this one ended."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
