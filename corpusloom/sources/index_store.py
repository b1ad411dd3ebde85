"""Index tables that are updated in part: buckets of keys, versions of buckets, one manifest.

Rows lie in buckets by a hash of their key (a document, book or point). An update reads and writes
the buckets of the keys it touches, as new files; all others stay as they are. A manifest names
the files of every bucket, and a new version is there once its manifest has been renamed into
place: a write that dies before has changed nothing, and a reader that has begun keeps its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
#: Keys that are sent to the stored rows they replace; with more of them both are shuffled.
KEYS_AT_ONCE = 1_000_000
#: Partitions of dealt rows for each of the session's: what is made of a row, as the postings of a text, is several times its size.
FINER = 4


class Conflict(RuntimeError):
    """Another update has been committed since the one that fails began."""


@dataclass(frozen=True)
class Manifest:
    """A version: its number, the number of buckets, the columns, and the folder of each bucket that has rows."""

    version: int
    buckets: int
    columns: str
    folders: dict[int, str]

    def said(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "columns": json.loads(self.columns), "folders": self.folders}, sort_keys=True)


class IndexStore:
    """A table at ``path`` with ``key`` as its key, several rows of which may have the same key.

    Within a file rows are sorted by ``sort``, so that filters on these columns skip row groups. Null
    keys are a key of their own. The path must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, sort: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.sort, self.buckets = spark, path.rstrip("/"), key, sort, buckets

    # The manifests, through the file system that Spark has for the path.

    def _file(self, path: str):
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), own

    def versions(self) -> list[int]:
        files, folder = self._file(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest version, or the one asked for; null before the first."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        said = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version:012d}.json").collect()))
        return Manifest(said["version"], said["buckets"], json.dumps(said["columns"]), {int(k): v for k, v in said["folders"].items()})

    def _commit(self, made: Manifest) -> None:
        files, draft = self._file(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = files.create(draft)
        out.write(bytearray(made.said().encode()))
        out.close()
        _, place = self._file(f"{self.path}/manifests/{made.version:012d}.json")
        files.mkdirs(place.getParent())
        if files.exists(place) or not files.rename(draft, place):
            raise Conflict(f"version {made.version} is there already")

    # Reading.

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of the one asked for, of all buckets or some."""
        own = self.manifest(version)
        if own is None:
            raise ValueError(f"no index at {self.path}")
        wanted = sorted(own.folders if buckets is None else set(buckets) & set(own.folders))
        columns = StructType.fromJson(json.loads(own.columns))
        if not wanted:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.path}/{own.folders[b]}" for b in wanted])

    def read_keys(self, keys: list) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        own = self.manifest()
        rows = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(own.buckets)).alias("b")).distinct().collect()
        return self.read(buckets=[r["b"] for r in rows]).where(F.col(self.key).cast("string").isin([str(k) for k in keys]))

    # Writing.

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_bucket``, in partitions by bucket and key.

        What is made of them by key and keeps ``_bucket`` needs no exchange, neither to be grouped nor in ``replace``.
        """
        before, key = self.manifest(), F.col(self.key)
        placed = rows.withColumn("_bucket", self.bucket(key, before.buckets if before else self.buckets))
        return placed.repartitionByRange(FINER * int(self.spark.conf.get("spark.sql.shuffle.partitions")), "_bucket", self.key)

    def replace(self, rows: DataFrame, touched: DataFrame) -> Manifest:
        """The rows of all keys in ``touched`` replaced by those in ``rows``; a key without new rows is gone.

        ``rows`` whose key is not in ``touched`` are put in too; those that have the ``_bucket`` of ``deal`` are not
        dealt again. They are made once. The first call makes the index.
        Raises ``Conflict``, and changes nothing, if another update is committed meanwhile.
        """
        before = self.manifest()
        buckets = before.buckets if before else self.buckets
        key, folder = F.col(self.key), f"data/{uuid.uuid4().hex}"
        columns = before.columns if before else rows.drop("_bucket").schema.json()
        stored = StructType.fromJson(json.loads(columns))
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stored]
        if "_bucket" in rows.columns:
            self._write(rows.select(*typed, "_bucket"), folder)
        else:
            self._write(self._rebalanced(rows.select(*typed).withColumn("_bucket", self.bucket(key, buckets))), folder)
        dirty: set[int] = set()
        if before:
            put = self.spark.read.schema(stored).parquet(f"{self.path}/{folder}")
            keys = touched.select(key).unionByName(put.select(key)).distinct()
            # At most as many rows as there are buckets.
            counts = {r["b"]: r["count"] for r in keys.groupBy(self.bucket(key, buckets).alias("b")).count().collect()}
            dirty = set(counts)
            if dirty & set(before.folders):
                few = sum(counts.values()) <= KEYS_AT_ONCE
                gone = keys.select(key.alias("_gone"))
                old = self.read(before.version, dirty)
                old = old.join(F.broadcast(gone) if few else gone, key.eqNullSafe(F.col("_gone")), "left_anti").withColumn("_bucket", self.bucket(key, buckets))
                # Stored rows lie by bucket: where they have not been shuffled they are written where they are read.
                self._write(old if few else self._rebalanced(old), folder)
        files, root = self._file(f"{self.path}/{folder}")
        written = {int(f.getPath().getName().split("=")[1]): f"{folder}/{f.getPath().getName()}" for f in files.listStatus(root) if f.getPath().getName().startswith("_bucket=")}
        kept = {b: f for b, f in (before.folders if before else {}).items() if b not in dirty}
        made = Manifest(before.version + 1 if before else 1, buckets, columns, kept | written)
        self._commit(made)
        return made

    def _rebalanced(self, placed: DataFrame) -> DataFrame:
        """Large buckets split over tasks and files, small ones put together."""
        return placed.hint("rebalance", "_bucket")

    def _write(self, placed: DataFrame, folder: str) -> None:
        placed.sortWithinPartitions("_bucket", *self.sort).write.partitionBy("_bucket").mode("append").parquet(f"{self.path}/{folder}")

    def upsert(self, rows: DataFrame, latest: str) -> Manifest:
        """One row a key: of the rows with a key, stored or new, the one with the greatest ``latest`` (a new one among equals) stays.

        Of new rows that tie the greatest by all its columns stays; a null ``latest`` is the least.
        """
        before, order = self.manifest(), Window.partitionBy(self.key)
        both = rows.withColumn("_new", F.lit(1))
        if before:
            keys = rows.select(F.col(self.key).alias("_key")).distinct()
            dirty = [r[0] for r in keys.select(self.bucket(F.col("_key"), before.buckets)).distinct().collect()]
            held = self.read(before.version, dirty).join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
            both = both.unionByName(held.withColumn("_new", F.lit(0)))
        ranked = both.withColumn("_n", F.row_number().over(order.orderBy(F.desc_nulls_last(latest), F.desc("_new"), F.desc(F.to_json(F.struct(*rows.columns))))))
        return self.replace(ranked.where("_n = 1").select(*rows.columns), rows.select(self.key))

    def clean(self, keep: int = 2) -> int:
        """Deletes the files that none of the newest ``keep`` versions names, and older manifests; gives how many folders went."""
        known = self.versions()
        newest = [self.manifest(v) for v in known[-keep:]]
        named = {f for m in newest for f in m.folders.values()}
        files, root = self._file(f"{self.path}/data")
        gone = 0
        for folder in files.listStatus(root) if files.exists(root) else []:
            for own in files.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{own.getPath().getName()}"
                if own.getPath().getName().startswith("_bucket=") and name not in named:
                    files.delete(own.getPath(), True)
                    gone += 1
        for version in known[:-keep]:
            files.delete(self._file(f"{self.path}/manifests/{version:012d}.json")[1], False)
        return gone
