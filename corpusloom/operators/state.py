"""Counters, caches, sessions and limits over event tables, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("queued", "extracting", "chunking", "embedding", "indexing", "completed", "failed")
FAILURES, WINDOW_SECONDS = 5, 900


def week_of_year(day: Column) -> Column:
    """The week of the year whose weeks begin on Monday; days before the first Monday are week 0."""
    return F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7).cast("int")


def daily(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key, F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def weekly(events: DataFrame, key: str, at: str) -> DataFrame:
    week = F.concat_ws("-", F.date_format(at, "yyyy"), F.lpad(week_of_year(F.col(at)).cast("string"), 2, "0"))
    return events.groupBy(key, week.alias("week")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, started, ended, beats): runs of events no more than a gap apart."""
    order = Window.partitionBy(key).orderBy(at)
    apart = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    new = F.when(apart <= gap_seconds * 1_000_000, 0).otherwise(1)
    marked = events.select(key, at, new.alias("new")).withColumn("session", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("beats"))


def rate(events: DataFrame, at: str, length: str, slide: str) -> DataFrame:
    """Events in sliding windows."""
    return events.groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


def _limiter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    who, opened, count = None, 0, 0
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if row.key != who:
                who, opened, count = row.key, 0, 0
            if count and row.at - opened >= WINDOW_SECONDS * 1_000_000:
                count = 0
            blocked = count >= FAILURES
            if row.failed:
                opened = opened if count else row.at
                count += 1
            elif not blocked:
                count = 0
            rows.append((row.key, row.at, row.failed, blocked))
        yield pd.DataFrame(rows, columns=["key", "at", "failed", "blocked"])


def login_limiter(events: DataFrame) -> DataFrame:
    """(key, at, failed, blocked): each try in turn against a window that opens at the first failure.

    ``events`` has key, at (microseconds) and failed; five failures within 15 minutes block,
    a success before that closes the window. A key's tries stream through one task in order,
    tries of one moment by ``event_id`` where there is one, else failures first.
    """
    tie = F.col("event_id") if "event_id" in events.columns else F.when(F.col("failed"), 0).otherwise(1)
    own = events.select(F.col("key").cast("long").alias("key"), F.col("at").cast("long").alias("at"), "failed", tie.cast("long").alias("tie"))
    return own.repartition("key").sortWithinPartitions("key", "at", "tie").mapInPandas(_limiter, "key long, at long, failed boolean, blocked boolean")


def cached_answers(asked: DataFrame, stored: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Questions with the answer stored under their key within some hours, or null."""
    live = stored.where(F.col("cached_at") + F.make_dt_interval(F.lit(0), F.lit(hours)) > now)
    return asked.join(live.select("key", "answer"), "key", "left").withColumn("was_cached", F.col("answer").isNotNull())


def served(computed: int | None, at: int, keep: int) -> tuple[bool, int]:
    """Whether an answer computed at a moment still serves a question at another, and when the answer given was computed."""
    return (True, computed) if computed is not None and at < computed + keep else (False, at)


def _read_through(keep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, computed = None, None
        for batch in batches:
            hits, times = [], []
            for key, at in zip(batch["key"], batch["at"]):
                if key != who:
                    who, computed = key, None
                hit, computed = served(computed, int(at), keep)
                hits.append(hit)
                times.append(computed)
            yield pd.DataFrame({"key": batch["key"], "event_id": batch["event_id"], "at": batch["at"], "was_cached": hits, "computed_at": times})

    return run


def read_through(asked: DataFrame, hours: int = 24) -> DataFrame:
    """(key, event_id, at, was_cached, computed_at) of questions (key, event_id, at in microseconds) against a cache with a time to live.

    An answer serves for some hours from when it was computed, however often it is read; the first question after that computes
    it again. Questions of a key go by time, then by event_id, through one task with one number of state. Rows without a key or
    a time are left out.
    """
    own = asked.where("key IS NOT NULL AND at IS NOT NULL").select("key", F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))
    kind = own.schema["key"].dataType.simpleString()
    dealt = own.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return dealt.mapInPandas(_read_through(hours * 3_600_000_000), f"key {kind}, event_id long, at long, was_cached boolean, computed_at long")


def cache_misses(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """What is still to be computed."""
    return asked.join(stored.select("key"), "key", "left_anti")


def job_states(updates: DataFrame) -> DataFrame:
    """The state of each job after all its updates: the last status, first start, and finish."""
    done = F.col("status").isin("completed", "failed")
    return updates.groupBy("job").agg(
        F.max_by("status", "at").alias("status"), F.min(F.when(F.col("status") != "queued", F.col("at"))).alias("started_at"),
        F.max(F.when(done, F.col("at"))).alias("finished_at"), F.max_by("progress", "at").alias("progress"),
    )


def phase_index(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PHASES]), status) - 1


def extraction_progress(done: Column, total: Column) -> Column:
    return (10 + F.floor(done / total * 15)).cast("int")


def retried(stale: DataFrame, most: int = 3) -> DataFrame:
    """Stale jobs queued again without their checkpoint, or failed after too many tries."""
    again = F.col("retry_count") < most
    return stale.withColumn("status", F.when(again, "queued").otherwise("failed")).withColumn("retry_count", F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count"))).withColumn("checkpoint", F.lit(None).cast("string"))
