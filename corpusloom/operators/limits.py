"""Leaky buckets: requests over a rate are let through while a bucket has room, and refused beyond.

A bucket holds what has come in and not yet drained. Were nothing refused, its level would follow
a recurrence of maxima and sums, which is a scan: with S(n) = n requests less what drains until
the n-th, the level ahead of the n-th is S(n) less the least S so far. The scan runs over slices
of time, then over the slices of a key, so that a busy key is many tasks. Wherever that level is
nought the real bucket is empty too, for refusals only lower it: between two such moments lies a
busy period, which stands alone. Only periods that come over the burst are gone through request by request.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of the slices of time that a key's requests are scanned in.
SLICE_SECONDS = 86_400


@dataclass(frozen=True)
class Limit:
    """So many requests in so many seconds, evenly, and so many at once beyond that."""

    rate: int
    seconds: int
    burst: int

    @property
    def one(self) -> int:
        """A request, in units of which ``rate`` drain in a microsecond."""
        return self.seconds * 1_000_000


# The limits of the edge, by what is asked for.
EDGE = {"ask": Limit(30, 60, 5), "login": Limit(30, 60, 10), "upload": Limit(5, 60, 2), "general": Limit(120, 60, 20)}


def admit(level: int, last: int | None, at: int, limit: Limit) -> tuple[bool, int, int]:
    """One request: whether it is let through, the level after it and the moment that is meant; a refused one changes nothing."""
    if last is None:
        return True, 0, at
    now = max(0, level - limit.rate * (at - last) + limit.one)
    return (True, now, at) if now <= limit.burst * limit.one else (False, level, last)


def _gone_through(limit: Limit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, level, last = None, 0, None
        for batch in batches:
            accepted, levels = [], []
            for key, period, at in zip(batch["key"], batch["period"], batch["at"]):
                if (key, period) != who:
                    who, level, last = (key, period), 0, None
                good, level, last = admit(level, last, int(at), limit)
                accepted.append(good)
                levels.append(level)
            yield pd.DataFrame({"key": batch["key"], "event_id": batch["event_id"], "at": batch["at"], "accepted": accepted, "level": levels})

    return run


def leaky_bucket(requests: DataFrame, limit: Limit, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(key, event_id, at, accepted, level) of every request (key, event_id, at in microseconds).

    Requests of a key go by time, then by event_id. ``level`` is what the key's bucket holds after the request, in
    requests of ``limit.one`` units. A key or time of null has no bucket: such requests are let through at level null.
    A period that never empties is gone through by one task, in order and with two numbers of state.
    """
    key_type = requests.schema["key"].dataType.simpleString()
    rows = requests.select("key", F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"))
    free = rows.where("key IS NULL OR at IS NULL").select("*", F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("level"))
    part = F.floor(F.col("at") / (slice_seconds * 1_000_000)).cast("long")
    own = rows.where("key IS NOT NULL AND at IS NOT NULL").withColumn("part", part)
    inside = Window.partitionBy("key", "part").orderBy("at", "event_id")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("n", F.row_number().over(inside)).withColumn("s", F.col("n") * F.lit(limit.one).cast("long") - F.col("at") * F.lit(limit.rate).cast("long")).withColumn("least", F.min("s").over(running))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("s").alias("low"))
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.withColumn("lowest", F.min(F.col("low") + F.col("earlier") * F.lit(limit.one).cast("long")).over(before)).select("key", "part", "earlier", "lowest")
    whole = own.join(parts, ["key", "part"]).withColumn("shift", F.col("earlier") * F.lit(limit.one).cast("long"))
    whole = whole.withColumn("period", F.least(F.col("least") + F.col("shift"), "lowest")).withColumn("level", F.col("s") + F.col("shift") - F.col("period"))
    # A level that refusals would have lowered: if it stays within the burst, nothing is refused.
    over = whole.groupBy("key", "period").agg((F.max("level") > limit.burst * limit.one).alias("over"))
    marked = whole.select("key", "event_id", "at", "period", "level").join(over, ["key", "period"])
    calm = marked.where("NOT over").select("key", "event_id", "at", F.lit(True).alias("accepted"), "level")
    busy = marked.where("over").select("key", "period", "event_id", "at").repartition("key", "period").sortWithinPartitions("key", "period", "at", "event_id")
    out = f"key {key_type}, event_id long, at long, accepted boolean, level long"
    return calm.unionByName(busy.mapInPandas(_gone_through(limit), out)).unionByName(free)
