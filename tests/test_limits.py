"""Leaky buckets: the scan with its busy periods, and the stream, against one request after the other."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.limits import EDGE, Limit, admit, leaky_bucket
from corpusloom.streaming import streams


def brute(rows, limit):
    state, out = {}, set()
    for key, event, at in sorted((r for r in rows if None not in (r[0], r[2])), key=lambda r: (r[2], r[1])):
        level, last = state.get(key, (0, None))
        good, level, last = admit(level, last, at, limit)
        state[key] = (level, last)
        out.add((key, event, at, good, level))
    return out | {(k, e, at, True, None) for k, e, at in rows if k is None or at is None}


@pytest.mark.parametrize("limit", [EDGE["ask"], Limit(1, 10, 0), Limit(7, 3, 2)])
def test_scan_and_periods_are_the_sequence(spark, limit):
    rng = random.Random(limit.rate)
    rows, n = [], 0
    for key in range(8):
        at = 1_700_000_000_000_000
        for _ in range(150 if key else 900):  # one key has most requests, some at the same moment
            at += rng.choice([0, 1000, 200_000, 1_000_000, 3_000_000, 40_000_000])
            rows.append((key, n, at))
            n += 1
    rows += [(None, n, 5), (3, n + 1, None)]
    table = spark.createDataFrame(rows, "key long, event_id long, at long").repartition(3)
    expected = brute(rows, limit)
    for seconds in (5, 86_400):
        found = [tuple(r) for r in leaky_bucket(table, limit, seconds).collect()]
        assert len(found) == len(rows) and set(found) == expected
    assert {True, False} <= {r[3] for r in expected}


def test_a_request_of_its_own_is_let_through_and_a_burst_is_cut():
    limit, level, last, good = Limit(60, 60, 2), 0, None, []
    for _ in range(5):
        one, level, last = admit(level, last, 0, limit)
        good.append(one)
    assert good == [True, True, True, False, False] and admit(level, last, 1_000_000, limit)[0]


def test_empty_requests(spark):
    assert leaky_bucket(spark.createDataFrame([], "key string, event_id long, at long"), EDGE["login"]).count() == 0


def test_the_stream_is_the_batch(spark, tmp_path):
    rng, at, rows = random.Random(4), datetime(2024, 1, 3, tzinfo=timezone.utc), []
    for n in range(400):
        at += timedelta(milliseconds=rng.choice([0, 10, 700, 5000]))
        rows.append((rng.randrange(3), n, at))
    spark.createDataFrame(rows, "key long, event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    streams.write_memory(streams.leaky_bucket(source, Limit(30, 60, 2)), "buckets", "append")
    batch = leaky_bucket(spark.read.parquet(str(tmp_path / "in")).withColumn("at", F.unix_micros("ts")), Limit(30, 60, 2))
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, batch.collect()))
