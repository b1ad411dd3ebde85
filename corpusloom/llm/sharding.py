"""Sharding by sampled splitters.

Equal texts are one record, their group, ordered by a 64-bit hash of the text, its checksum
and its size. A sample of groups drawn with probability in proportion to their bytes gives
the quantile boundaries of up to ``MOST_RANGES`` ranges; ranges that turn out overfull, in rows
or bytes, are subdivided until none has more than ``RANGE_ROWS`` groups. Prefix sums over the
ranges place every group at its exact byte offset, from which its shard follows. A group too
large for one shard is divided between neighbours by the running number of its rows. A text
that fills a third of the corpus is one group here, and its rows are never in one task.

The driver gets samples and sizes of at most ``MOST_RANGES`` ranges, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, forget, join_hot, require, text_or_empty

#: Ranges per shard, ranges at most, and the most groups that a range, subdivided or not, may have.
RANGES_PER_SHARD = 4
MOST_RANGES = 1024
RANGE_ROWS = 1_000_000
#: Sampled groups per range.
SAMPLES_PER_RANGE = 64
#: A range over this many times its share of the bytes is subdivided.
OVERFULL = 2.0
#: A group of equal texts up to this part of a shard is not divided between shards.
WHOLE_GROUP = 0.01
#: Rows of one scan task that are numbered together: 2 to this power.
CHUNK_BITS = 20


def _splitters(groups: DataFrame, n_ranges: int, total: int, seed: int) -> np.ndarray:
    """Quantiles of the hashes of a sample of groups, each drawn with probability in proportion to its bytes."""
    chance = F.col("bytes") * (SAMPLES_PER_RANGE * n_ranges / max(total, 1))
    uniform = F.pmod(F.xxhash64("hash", "crc", "size", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = np.array(sorted(r["hash"] for r in groups.where(uniform < chance).select("hash").collect()), dtype=np.int64)
    return np.unique(drawn[(np.arange(1, n_ranges) * len(drawn)) // n_ranges]) if len(drawn) else drawn


def _ranges(splitters: np.ndarray, parts: np.ndarray):
    """(range, part) of a hash: ``splitters`` are first hashes of ranges, a range has some equally wide parts."""
    low = np.concatenate([[float(-(1 << 63))], splitters.astype(np.float64)])
    width = np.diff(np.append(low, float(1 << 63))) / parts

    @F.pandas_udf("struct<range: int, part: int>")
    def range_of(key: pd.Series) -> pd.DataFrame:
        values = key.to_numpy(np.int64)
        own = np.searchsorted(splitters, values, "right")
        part = np.floor((values.astype(np.float64) - low[own]) / np.maximum(width[own], 1.0))
        return pd.DataFrame({"range": own.astype(np.int32), "part": np.clip(part, 0, parts[own] - 1).astype(np.int32)})

    return range_of


def _dealt(groups: DataFrame, splitters: np.ndarray, parts: np.ndarray) -> DataFrame:
    return groups.withColumn("at", _ranges(splitters, parts)("hash")).select(*groups.columns, "at.range", "at.part")


def _divided(groups: DataFrame, n_ranges: int, total: int, range_rows: int, seed: int) -> DataFrame:
    """``groups`` with range, part and ``range_start``, the bytes ahead of the range."""
    splitters = _splitters(groups, n_ranges, total, seed)
    parts = np.ones(len(splitters) + 1, dtype=np.int64)
    while True:
        dealt = _dealt(groups, splitters, parts)
        pieces = dealt.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        found = pieces.groupBy("range").agg(F.max("n").alias("n"), F.max(F.col("bytes") - F.col("largest")).alias("over"), F.sum("bytes").alias("bytes")).collect()
        share, before = total / max(n_ranges, 1), parts.copy()
        for r in found:
            times = max(r["n"] / range_rows, r["over"] / (OVERFULL * share) if share else 0)
            if times > 1 and r["n"] > 1 and parts[r["range"]] < 1 << 30:  # a part of one hash alone cannot be divided
                parts[r["range"]] *= 1 << int(np.ceil(np.log2(times)) + (times > 1))
        if (parts == before).all():
            break
    sizes = {r["range"]: r["bytes"] for r in found}
    starts, before_ = [], 0
    for k in sorted(sizes):
        starts.append((k, before_))
        before_ += sizes[k]
    table = groups.sparkSession.createDataFrame(starts, "range int, range_start long")
    return dealt.join(F.broadcast(table), "range")  # at most MOST_RANGES rows


def _numbered(rows: DataFrame, within: str) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 for each value of ``within``, by their ``row``.

    Rows are numbered in chunks of one scan task, and chunks are put one after the other, so
    a value that most rows have is no hot key.
    """
    chunked = rows.withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    order = Window.partitionBy(within).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunked.groupBy(within, "chunk").agg(F.count("*").alias("n"))
    firsts = checkpoint(chunks.select(within, "chunk", (F.sum("n").over(order) - F.col("n")).alias("first")))
    own = F.row_number().over(Window.partitionBy(within, "chunk").orderBy("row")) - 1
    return chunked.withColumn("own", own).join(firsts, [within, "chunk"]).withColumn("number", F.col("first") + F.col("own")).drop("chunk", "own", "first")


def shard(docs: DataFrame, n_shards: int = 24, whole_group: float = WHOLE_GROUP, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their shard by the law ``bytes``: shard sizes near equal.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot
    (gapless from 0 in each shard) and grown_shard (null under this law). Equal texts share a
    shard unless they exceed ``whole_group`` of a shard's bytes: then the group is divided
    between neighbouring shards, as one text may hold a third of all rows.

    A null text has size 8 and the checksum of the empty text, with which it is grouped; a null
    ``doc_id`` is no obstacle; repeated rows each get a slot of their own; of a text, however
    long, the tasks see only its hash, checksum and size. An empty table gives an empty result,
    and other columns are neither read nor returned.
    """
    require(docs, ["doc_id", "text"])
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"))
    base = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.concat_ws(":", "hash", "crc", "size")))
    groups = checkpoint(base.groupBy("group", "hash", "crc", "size").agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")))
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    n_ranges = min(MOST_RANGES, max(RANGES_PER_SHARD * n_shards, -(-n_groups // range_rows)))
    dealt = checkpoint(_divided(groups, n_ranges, total, range_rows, seed))
    parts = dealt.groupBy("range", "part").agg(F.sum("bytes").alias("part_bytes"))
    ahead = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = checkpoint(parts.select("range", "part", (F.sum("part_bytes").over(ahead) - F.col("part_bytes")).alias("part_start")))
    order = Window.partitionBy("range", "part").orderBy("hash", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("range_start") + F.col("part_start") + F.sum("bytes").over(order) - F.col("bytes")
    placed = checkpoint(dealt.join(parts, ["range", "part"]).select("group", "n", "bytes", start.alias("start")))

    def shard_at(place: Column) -> Column:
        return F.least(F.lit(n_shards - 1), F.floor(place * n_shards / F.lit(max(total, 1)))).cast("int")

    is_large = F.col("bytes") > whole_group * total / n_shards
    large = F.broadcast(placed.where(is_large).select("group", "start"))  # fewer than n_shards / whole_group
    whole = placed.where(~is_large).select("group", "n", shard_at(F.col("start") + F.col("bytes") / 2).alias("shard"))
    divided = _numbered(base.join(large, "group"), "group").withColumn("shard", shard_at(F.col("start") + F.col("number") * F.col("size") + F.col("size") / 2))
    rest = join_hot(base.join(large, "group", "left_anti"), whole, "group", "n", F.col("row"))
    columns = ["doc_id", "size", "crc", "row", "shard"]
    sharded = checkpoint(rest.select(*columns).unionByName(divided.select(*columns)))
    forget(base, groups, dealt, parts, placed)
    return _numbered(sharded, "shard").select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("number").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
