"""Streams run to their end give what the batch forms give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import state
from corpusloom.streaming import streams

SCHEMA = "user_id long, ts timestamp, event_type string"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    start = datetime(2024, 1, 3)
    rows = [(n % 5, start + timedelta(minutes=37 * n), "error" if n % 3 else "click") for n in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(folder)
    return folder


def run(spark, made, name, mode):
    streams.write_memory(made, name, mode)
    return spark.table(name)


def stream(spark, source):
    return spark.readStream.schema(SCHEMA).parquet(source)


def test_daily_counts(spark, source):
    found = run(spark, streams.daily_counts(stream(spark, source), "user_id", "ts"), "daily", "complete")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, state.daily(spark.read.parquet(source), "user_id", "ts").collect()))


def test_weeks_begin_on_monday(spark, source):
    found = run(spark, streams.weekly_counts(stream(spark, source), "user_id", "ts"), "weekly", "complete").collect()
    assert all(datetime.fromisoformat(r["week_start"]).weekday() == 0 for r in found) and sum(r["n"] for r in found) == 300


def test_login_limiter(spark, source):
    tries = stream(spark, source).select(F.col("user_id").alias("key"), "ts", (F.col("event_type") == "error").alias("failed"))
    found = run(spark, streams.login_limiter(tries), "limits", "append").collect()
    batch = spark.read.parquet(source).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    assert sorted(map(tuple, found)) == sorted(map(tuple, state.login_limiter(batch).collect()))


def test_job_states(spark, source):
    updates = stream(spark, source).select(F.col("user_id").alias("job"), F.unix_micros("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("queued").alias("status"))
    found = {r["job"]: r for r in run(spark, streams.job_states(updates), "jobs", "update").collect()}
    batch = state.job_states(spark.read.parquet(source).select(F.col("user_id").alias("job"), F.unix_micros("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("queued").alias("status"), F.lit(0).alias("progress")))
    for r in batch.collect():
        assert (found[r["job"]]["status"], found[r["job"]]["started_at"], found[r["job"]]["finished_at"]) == (r["status"], r["started_at"], r["finished_at"])


def test_silent_workers_are_reported(spark, tmp_path):
    import time

    folder = tmp_path / "beats"
    write = lambda rows: spark.createDataFrame(rows, "key long, at long").coalesce(1).write.mode("append").parquet(str(folder))
    write([(1, 10), (2, 10), (1, 20)])
    found = streams.silent_workers(spark.readStream.schema("key long, at long").parquet(str(folder)), seconds=3)
    query = found.writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        n = 0
        while spark.table("silent").where("key = 2").count() == 0 and time.time() < until:
            n += 1
            write([(1, 100 * n)])  # worker 1 goes on, worker 2 has gone silent
            time.sleep(0.4)
        rows = {r["key"]: (r["last_beat"], r["beats"]) for r in spark.table("silent").collect()}
        assert rows[2] == (10, 1)
    finally:
        query.stop()


def test_a_repeated_batch_dispatches_nothing_twice(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, "job long").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("job long").parquet(source)
    write([(1,), (2,)])
    streams.dispatch(stream(), out, checkpoint).awaitTermination()
    again = streams.dispatch_batch(out)
    again(spark.createDataFrame([(1,), (2,)], "job long"), 0)  # as after a failure between write and commit
    write([(3,)])
    streams.dispatch(stream(), out, checkpoint).awaitTermination()  # a restart goes on where it stopped
    assert sorted(r["job"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_a_cache_read_through(spark, tmp_path):
    start = datetime(2024, 1, 3)
    rows = [(n % 4, n, start + timedelta(minutes=191 * (n // 2))) for n in range(200)]
    spark.createDataFrame(rows, "key long, event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    asked = spark.readStream.schema("key long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    found = sorted(map(tuple, run(spark, streams.read_through(asked, 24), "cached", "append").collect()))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("at", F.unix_micros("ts"))
    assert found == sorted(map(tuple, state.read_through(batch, 24).collect()))
    computed = {}
    for key, event, at, hit, when in sorted(found, key=lambda r: (r[2], r[1])):
        assert hit == (key in computed and at < computed[key] + 24 * 3_600_000_000)
        computed[key] = computed[key] if hit else at
        assert when == computed[key]
    assert {True, False} == {r[3] for r in found}
