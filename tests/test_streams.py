"""The breaker over a stream: order, carried streaks, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import versions
from dossier.streaming import health

ATTEMPTS = "provider_id long, seq long, ok boolean"


def fold(attempts, streak=None):
    streak, out = dict(streak or {}), []
    for p, s, ok in sorted(attempts, key=lambda r: (r[1], bool(r[2]))):
        streak[p] = 0 if ok else streak.get(p, 0) + 1
        out.append((p, s, streak[p]))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_streaks_across_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), s // 2, r.choice([True, False, False, False, None])) for s in range(400)]
    rows += [(9, s, False) for s in range(300)]  # no success in any range
    carried = {1: 2, 9: 5, 4: 1}
    out = health.streaks(spark.createDataFrame(rows, ATTEMPTS), spark.createDataFrame(list(carried.items()), "provider_id long, streak long"), ranges)
    assert sorted((tuple(x) for x in out.select("provider_id", "seq", "consecutive_failures").collect()), key=str) == fold(rows, carried)


def test_streaks_of_nothing(spark):
    none = spark.createDataFrame([], ATTEMPTS)
    assert health.streaks(none, spark.createDataFrame([], "provider_id long, streak long")).count() == 0


def _append(spark, folder, rows):
    spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.select("provider_id", "seq", "consecutive_failures").collect()), key=str)


@pytest.mark.parametrize("broken", ["before its rows", "before its state", "after its state"])
def test_a_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, broken):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    r, rows = random.Random(3), []
    for b in range(3):
        part = [(r.randrange(3), 10 * b + s, r.random() < 0.3) for s in range(10)]
        _append(spark, source, part)
        rows += part
    streaks, commit, calls = health.streaks, versions.Table.commit, []

    def fail(real, after):
        def broken_step(*args, **more):
            calls.append(0)
            if len(calls) != 2:
                return real(*args, **more)
            if after:
                real(*args, **more)
            raise RuntimeError("broke off")

        return broken_step

    if broken == "before its rows":
        monkeypatch.setattr(health, "streaks", fail(streaks, False))
    else:
        monkeypatch.setattr(versions.Table, "commit", fail(commit, broken == "after its state"))
    with pytest.raises(Exception, match="broke off"):
        health.run_breaker(_stream(spark, source), folder)
    seen = 20 if broken == "after its state" else 10
    assert _rows(health.breaker_rows(spark, folder)) == fold(rows[:seen])  # whole batches only
    monkeypatch.undo()
    assert _rows(health.run_breaker(_stream(spark, source), folder)) == fold(rows)

    more = [(1, 100 + s, s == 2) for s in range(4)]
    _append(spark, source, more)
    assert _rows(health.run_breaker(_stream(spark, source), folder)) == fold(rows + more)


def test_state_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(health, "COMPACT_EVERY", 2)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, s, False) for s in range(3)]
    for row in rows:
        _append(spark, source, [row])
    out = health.run_breaker(_stream(spark, source), folder)
    assert _rows(out) == fold(rows) and out.where("status = 'unhealthy'").count() == 1
    assert [e.kind for e in versions.Table(spark, f"{folder}/state", ["provider_id"]).entries()] == ["changes", "changes", "compacted", "changes"]


def test_windows_through_files(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, ts timestamp, event_type string"

    def put(*hours):
        rows = spark.createDataFrame([(1, h, "error") for h in hours], "user_id long, h int, event_type string")
        rows.select("user_id", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, h)").alias("ts"), "event_type").write.mode("append").parquet(source)
        return health.run_to_files(health.activity(spark.readStream.schema(schema).parquet(source)), folder).select(F.hour("start")).collect()

    assert sorted(r[0] for r in put(0, 1, 5)) == [0, 1]
    assert sorted(r[0] for r in put(9)) == [0, 1, 5]  # of the first run's state
