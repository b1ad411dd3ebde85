"""Shards: sizes, whole groups, slots, and the bounds on what a task gets."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding


def check(rows, n_shards, whole_group=sharding.WHOLE_GROUP):
    """Law, groups and slots of some rows."""
    sizes, slots, shards_of, group_bytes = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards_of[r["text_crc32"], r["size"]].add(r["shard"])
        group_bytes[r["text_crc32"], r["size"]] += r["size"]
    total = sum(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    limit = whole_group * total / n_shards
    assert all(len(shards_of[g]) == 1 for g in group_bytes if group_bytes[g] <= limit)
    largest = max(r["size"] for r in rows)
    assert len(sizes) == n_shards and max(sizes.values()) - min(sizes.values()) <= 2 * (limit + largest)


@pytest.mark.parametrize("seed", range(4))
def test_groups_stay_whole(spark, seed):
    rng = random.Random(seed)
    texts = []
    for n in range(2600):
        texts += [f"group {n} " + "x" * rng.randrange(60)] * rng.randrange(1, 6)
    rng.shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check(sharding.shard(table, 24, seed=seed).collect(), 24)


@pytest.mark.parametrize("range_rows", [sharding.RANGE_ROWS, 100])
def test_most_texts_are_null(spark, range_rows):
    table = spark.range(30_000).selectExpr("if(id % 7 = 0, null, id) AS doc_id", "if(id % 5 < 3, null, repeat(cast(id AS string), 1 + id % 9)) AS text", "'x' AS group", "1 AS size", "2 AS n")
    found = sharding.shard(table, 24, range_rows=range_rows).collect()
    assert len(found) == 30_000
    check(found, 24)


def test_ranges_are_bounded_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_RANGES", 4)
    table = spark.range(20_000).select(F.xxhash64("id").alias("hash"), F.lit(1).alias("crc"), F.lit(9).alias("size"), F.when(F.col("id") == 5, 10**7).otherwise(9).cast("long").alias("bytes"))
    table = table.where("hash > 0 OR hash % 50 = 0")  # uneven
    total = table.agg(F.sum("bytes")).first()[0]
    dealt = sharding._divided(table, 4, total, 300, 1)
    sizes = dealt.groupBy("range", "part", "range_start").count().collect()
    assert max(r["count"] for r in sizes) <= 300 and len({r["range"] for r in sizes}) <= 4
    assert dealt.count() == table.count()
    placed = sorted((r["hash"], r["range"], r["part"]) for r in dealt.collect())
    assert [x[1:] for x in placed] == sorted(x[1:] for x in placed)


def test_few_rows(spark):
    one = spark.createDataFrame([(3, "only")], "doc_id long, text string")
    (row,) = sharding.shard(one).collect()
    assert (row["doc_id"], row["size"], row["slot"]) == (3, 12, 0)
    same = spark.createDataFrame([(n, None) for n in range(48)], "doc_id long, text string")
    assert Counter(r["shard"] for r in sharding.shard(same).collect()) == Counter({n: 2 for n in range(24)})
