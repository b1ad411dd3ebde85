"""Structured Streaming forms of counters, heartbeats, limits and job states.

Sources are any streaming DataFrame with an event time; state expires by timers, so it stays
in proportion to live keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from corpusloom.operators.limits import Limit, admit
from corpusloom.operators.state import FAILURES, WINDOW_SECONDS, served

#: Monday: the epoch was a Thursday.
MONDAY = "4 days"


def daily_counts(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def weekly_counts(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, "7 days", startTime=MONDAY).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.date_format("w.start", "yyyy-MM-dd").alias("week_start"), "n")


def heartbeat_sessions(beats: DataFrame, key: str, at: str, gap: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Spans of beats; one that has ended is a worker that went silent."""
    out = beats.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("beats"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "beats")


def rates(events: DataFrame, at: str, length: str = "1 minute", slide: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


def merged_events(jobs: DataFrame, books: DataFrame) -> DataFrame:
    """Two channels as one stream of (kind, at, data)."""
    columns = ["kind", "at", "data"]
    return jobs.withColumn("kind", F.lit("job-update")).select(*columns).unionByName(books.withColumn("kind", F.lit("book-update")).select(*columns))


def once_per_key(requests: DataFrame, key: str, at: str, within: str = "2 minutes") -> DataFrame:
    """Requests without repeats of a key within some time: the dispatcher's lock."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


LIMIT_OUT = StructType([StructField("key", LongType()), StructField("at", LongType()), StructField("failed", BooleanType()), StructField("blocked", BooleanType())])
_LIMIT_STATE = StructType([StructField("opened", LongType()), StructField("count", LongType())])


class _Limiter(StatefulProcessor):
    """A window of failures that opens at the first one and is closed by a success or by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", _LIMIT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, count = self.state.get() if self.state.exists() else (0, 0)
        # Tries of one moment go as in the batch form: failures first.
        tries = pd.concat(list(rows)).sort_values(["at", "failed"], ascending=[True, False], kind="stable")
        out = []
        for row in tries.itertuples():
            if count and row.at - opened >= WINDOW_SECONDS * 1_000_000:
                count = 0
            blocked = count >= FAILURES
            if row.failed:
                opened, count = (opened if count else row.at), count + 1
            elif not blocked:
                count = 0
            out.append((key[0], row.at, row.failed, blocked))
        if count:
            self.state.update((int(opened), int(count)))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(opened) // 1000 + WINDOW_SECONDS * 1000)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=["key", "at", "failed", "blocked"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["key", "at", "failed", "blocked"])

    def close(self) -> None:
        pass


def login_limiter(tries: DataFrame, at: str = "ts", late: str = "1 minute") -> DataFrame:
    """The streaming form of ``operators.state.login_limiter``; needs the RocksDB state store."""
    own = tries.withWatermark(at, late).select(F.col("key").cast("long").alias("key"), F.unix_micros(F.col(at)).alias("at"), "failed", F.col(at).alias("event_time"))
    return own.groupBy("key").transformWithStateInPandas(_Limiter(), LIMIT_OUT, "Append", "EventTime")


CACHE_OUT = StructType([StructField("key", LongType()), StructField("event_id", LongType()), StructField("at", LongType()), StructField("was_cached", BooleanType()), StructField("computed_at", LongType())])
_CACHE_STATE = StructType([StructField("computed", LongType())])


class _Cache(StatefulProcessor):
    """When an answer was computed; a timer of event time drops it when it no longer serves."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("computed", _CACHE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        computed = int(self.state.get()[0]) if self.state.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            hit, computed = served(computed, int(row.at), self.keep)
            out.append((key[0], int(row.event_id), int(row.at), hit, computed))
        self.state.update((computed,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((computed + self.keep) // 1000 + 1)
        yield pd.DataFrame(out, columns=CACHE_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=CACHE_OUT.names)

    def close(self) -> None:
        pass


def read_through(asked: DataFrame, hours: int = 24, at: str = "ts", late: str = "1 minute") -> DataFrame:
    """The streaming form of ``operators.state.read_through`` for (key, event_id, ts); needs the RocksDB state store."""
    own = asked.withWatermark(at, late).select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col(at)).alias("at"), F.col(at).alias("event_time"))
    return own.groupBy("key").transformWithStateInPandas(_Cache(hours * 3_600_000_000), CACHE_OUT, "Append", "EventTime")


REAPED = StructType([StructField("key", LongType()), StructField("last_beat", LongType()), StructField("beats", LongType())])
_BEATS = StructType([StructField("last", LongType()), StructField("beats", LongType())])


class _Reaper(StatefulProcessor):
    """A worker's heartbeat: a timer of processing time that each beat puts off."""

    def __init__(self, milliseconds: int) -> None:
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("beats", _BEATS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, beats = self.state.get() if self.state.exists() else (0, 0)
        for batch in rows:  # sums and maxima: no rows are held
            last, beats = max(int(last), int(batch["at"].max())), int(beats) + len(batch)
        self.state.update((last, beats))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        yield pd.DataFrame([], columns=REAPED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, beats = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], int(last), int(beats))], columns=REAPED.names)

    def close(self) -> None:
        pass


def silent_workers(beats: DataFrame, seconds: float = 60.0) -> DataFrame:
    """(key, last_beat, beats): each worker once it has not been heard of for some seconds, and again if it comes back and goes silent.

    ``beats`` has key and at (microseconds). Time is that of processing: a stream that stands still counts no
    one as silent until its next trigger. Needs the RocksDB state store.
    """
    own = beats.select(F.col("key").cast("long").alias("key"), F.col("at").cast("long").alias("at"))
    return own.groupBy("key").transformWithStateInPandas(_Reaper(int(seconds * 1000)), REAPED, "Append", "ProcessingTime")


def dispatch_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch of requests under its number; the same batch again replaces what it wrote before."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def dispatch(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes each request once, also when a batch is repeated after a failure or restart."""
    made = requests.writeStream.foreachBatch(dispatch_batch(path)).option("checkpointLocation", checkpoint)
    return made.trigger(**(trigger or {"availableNow": True})).start()


BUCKET_OUT = StructType([StructField("key", LongType()), StructField("event_id", LongType()), StructField("at", LongType()), StructField("accepted", BooleanType()), StructField("level", LongType())])
_BUCKET_STATE = StructType([StructField("level", LongType()), StructField("last", LongType())])


class _Bucket(StatefulProcessor):
    """A leaky bucket; its state goes once it has drained."""

    def __init__(self, limit: Limit) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", _BUCKET_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, last = self.state.get() if self.state.exists() else (0, None)
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            good, level, last = admit(int(level), None if last is None else int(last), int(row.at), self.limit)
            out.append((key[0], int(row.event_id), int(row.at), good, level))
        self.state.update((int(level), int(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # An empty bucket and none admit alike once a whole request more has drained.
        drained = int(last) + (int(level) + self.limit.one) // self.limit.rate + 1
        self.handle.registerTimer(drained // 1000 + 1)
        yield pd.DataFrame(out, columns=BUCKET_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=BUCKET_OUT.names)

    def close(self) -> None:
        pass


def leaky_bucket(requests: DataFrame, limit: Limit, at: str = "ts", late: str = "1 minute") -> DataFrame:
    """The streaming form of ``operators.limits.leaky_bucket`` for (key, event_id, ts); needs the RocksDB state store.

    Requests of one micro-batch go by time; one that comes after its successors were admitted meets the bucket as it is then.
    """
    own = requests.withWatermark(at, late).select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col(at)).alias("at"), F.col(at).alias("event_time"))
    return own.groupBy("key").transformWithStateInPandas(_Bucket(limit), BUCKET_OUT, "Append", "EventTime")


JOB_OUT = StructType([StructField("job", LongType()), StructField("status", StringType()), StructField("started_at", LongType()), StructField("finished_at", LongType())])
_JOB_STATE = StructType([StructField("status", StringType()), StructField("at", LongType()), StructField("started_at", LongType()), StructField("finished_at", LongType())])


class _Jobs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", _JOB_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, at, started, finished = self.state.get() if self.state.exists() else (None, -1, None, None)
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            if row.at >= at:
                status, at = row.status, row.at
            if row.status != "queued":
                started = row.at if started is None else min(started, row.at)
            if row.status in ("completed", "failed"):
                finished = row.at if finished is None else max(finished, row.at)
        plain = lambda x: None if x is None else int(x)
        self.state.update((status, int(at), plain(started), plain(finished)))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "started_at": pd.array([plain(started)], "Int64"), "finished_at": pd.array([plain(finished)], "Int64")})

    def close(self) -> None:
        pass


def job_states(updates: DataFrame) -> DataFrame:
    """The state of each job after every batch of updates (job, at, status)."""
    return updates.groupBy("job").transformWithStateInPandas(_Jobs(), JOB_OUT, "Update", "None")


def write_memory(stream: DataFrame, name: str, mode: str) -> None:
    """Run a bounded stream to its end into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
