"""The relational catalogue: books, jobs, users and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(books: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows of which a column contains a text, whatever its case; % and _ are wild."""
    if not text:
        return books
    out = F.lit(False)
    for column in columns:
        out = out | F.coalesce(F.col(column).ilike(f"%{text}%"), F.lit(False))
    return books.where(out)


def list_page(books: DataFrame, sort_by: str, key: str, allowed: tuple[str, ...], descending: bool = False, page_size: int = 20, skip: int = 0) -> DataFrame:
    """One page of a sorted list: nulls last ascending and first descending, ties by ``key``."""
    if sort_by not in allowed:
        raise ValueError(f"cannot sort by {sort_by}; allowed are {allowed}")
    order = F.col(sort_by).desc_nulls_first() if descending else F.col(sort_by).asc_nulls_last()
    return books.orderBy(order, F.col(key)).offset(skip).limit(page_size)


def page_totals(books: DataFrame, page_size: int) -> DataFrame:
    return books.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long"))


def recent(rows: DataFrame, at: str, key: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def with_status(rows: DataFrame, status: str, wanted: tuple[str, ...], within: bool = True) -> DataFrame:
    return rows.where(F.col(status).isin(*wanted) if within else ~F.col(status).isin(*wanted))


def latest_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times, towards zero; null if one is missing."""
    return ((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)).cast("int")


def tenant_totals(books: DataFrame, tenant: str, amount: str) -> DataFrame:
    return books.groupBy(tenant).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """The part of requests that were hits, to four places: ten thousandths are rounded as a double, not the share's shortest decimal form."""
    return F.when(hits + misses > 0, F.round(hits / (hits + misses) * 10000) / 10000).otherwise(F.lit(0.0))


def exact_sum(values: Column) -> Column:
    """The sum of doubles as decimals of up to ten places: it depends neither on their order nor on how they are dealt."""
    return F.sum(values.cast("decimal(28,10)"))


def whole_mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.floor(total / count).cast("long")).otherwise(F.lit(0).cast("long"))


def valid_tokens(tokens: DataFrame, users: DataFrame, user_key: str, now: Column) -> DataFrame:
    """Tokens of known users that have not expired, with the user's columns."""
    return tokens.where(F.col("expires_at") > now).join(users, user_key)


def same_address(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def orphans(jobs: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """Jobs whose book is gone."""
    return jobs.join(books.select(key), key, "left_anti")


def stale(running: DataFrame, beats: DataFrame, key: str, now: Column) -> DataFrame:
    """Running jobs without a heartbeat that still holds."""
    return running.join(beats.where(F.col("expires_at") > now).select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with their keys; of equals the latest ``ingested``.

    Of rows ingested at the same moment a new one goes before a stored one, then the greatest by its columns.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("ingested"), F.desc("_new"), F.desc(F.to_json(F.struct(*stored.columns))))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def delete_by(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those of deleted keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose reference to a deleted key is null."""
    marked = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(marked, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def patch(rows: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with the columns of ``changes`` where those are set."""
    named = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = rows.join(named, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out.select(*rows.columns)


def set_status(rows: DataFrame, key: str, value: object, **changes: object) -> DataFrame:
    """Rows with some columns of one key replaced."""
    for c, v in changes.items():
        rows = rows.withColumn(c, F.when(F.col(key) == F.lit(value), F.lit(v)).otherwise(F.col(c)))
    return rows


def with_defaults(rows: DataFrame, **defaults: object) -> DataFrame:
    """Rows with a default in place of a null in each of some columns."""
    return rows.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def preview(text: Column, length: int = 200) -> Column:
    """The beginning of a text, as lists show it."""
    return F.substring(text, 1, length)


def attributes_missing(stored: Column, wanted: Column) -> Column:
    """What an index still lacks of the attributes that are wanted; empty if it has them all."""
    return F.array_except(wanted, F.coalesce(stored, F.array().cast("array<string>")))


def attributes_merged(stored: Column, wanted: Column) -> Column:
    """The attributes of an index and those wanted, each once, sorted."""
    return F.array_sort(F.array_union(F.coalesce(stored, F.array().cast("array<string>")), wanted))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and are not."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def settings(stored: DataFrame, **defaults: object) -> DataFrame:
    """The one row of settings with defaults where it or a column is missing."""
    first = stored.where("id = 1").select(*[F.first(c).over(Window.partitionBy("id")).alias(c) for c in defaults]).limit(1)
    base = stored.sparkSession.range(1).select(*[F.lit(v).alias(f"_{c}") for c, v in defaults.items()])
    return base.join(first, F.lit(True), "left").select(*[F.coalesce(c, f"_{c}").alias(c) for c in defaults])
