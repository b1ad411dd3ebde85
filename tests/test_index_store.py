"""Stored indexes: what an update leaves alone, and what a failed one changes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.sources import index_store
from corpusloom.sources.index_store import Conflict, IndexStore


def passages(spark, rows):
    return spark.createDataFrame(rows, "id long, book string, text string")


def contents(store):
    return sorted((tuple(r) for r in store.read().select("term", "id", "book", "tf").collect()), key=repr)


def of(spark, rows):
    return sorted((tuple(r) for r in retrieval.postings(passages(spark, rows), "book").select("term", "id", "book", "tf").collect()), key=repr)


def files(folder):
    return {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), "book", ("term",), buckets=16)


def test_an_update_writes_only_what_it_touches(spark, store):
    rows = [(n, f"b{n % 20}", f"one two{n} three three") for n in range(60)]
    first = store.replace(retrieval.postings(passages(spark, rows), "book"), passages(spark, rows))
    assert contents(store) == of(spark, rows) and first.version == 1
    before = files(store.path)
    changed = [(n, b, f"other words {n}") if b == "b3" else (n, b, t) for n, b, t in rows if b != "b4"]
    touched = spark.createDataFrame([("b3",), ("b4",)], "book string")
    second = store.replace(retrieval.postings(passages(spark, [r for r in changed if r[1] == "b3"]), "book"), touched)
    assert contents(store) == of(spark, changed)
    after = files(store.path)
    assert all(after[p] == known for p, known in before.items())  # nothing that was there is written again
    same = [b for b in first.folders if second.folders.get(b) == first.folders[b]]
    assert len(same) >= len(first.folders) - 2
    assert sorted((tuple(r) for r in store.read(1).select("term", "id", "book", "tf").collect()), key=repr) == of(spark, rows)
    assert {r["book"] for r in store.read_keys(["b3"]).collect()} == {"b3"}


def test_a_write_that_dies_changes_nothing(spark, store):
    rows = [(n, f"b{n % 5}", "one two") for n in range(20)]
    store.replace(retrieval.postings(passages(spark, rows), "book"), passages(spark, rows))
    held, before = contents(store), files(store.path)
    failing = retrieval.postings(passages(spark, [(1, "b1", "x y")]), "book").withColumn("tf", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.replace(failing, passages(spark, [(1, "b1", "")]))
    assert contents(store) == held and store.manifest().version == 1
    assert all(files(store.path)[p] == known for p, known in before.items())


def test_a_write_that_comes_second_fails(spark, store, monkeypatch):
    rows = [(1, "a", "one")]
    store.replace(retrieval.postings(passages(spark, rows), "book"), passages(spark, rows))
    other = IndexStore(spark, store.path, "book", ("term",))
    real = store._commit

    def late(made):
        other.replace(retrieval.postings(passages(spark, [(2, "b", "two")]), "book"), passages(spark, [(2, "b", "")]))
        real(made)

    monkeypatch.setattr(store, "_commit", late)
    with pytest.raises(Conflict):
        store.replace(retrieval.postings(passages(spark, [(3, "c", "three")]), "book"), passages(spark, [(3, "c", "")]))
    assert {r["book"] for r in other.read().collect()} == {"a", "b"} and other.versions() == [1, 2]


def test_upserts_keep_the_latest_row(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "points"), "id", buckets=8)
    make = lambda rows: spark.createDataFrame(rows, "id long, ingested long, said string")
    store.upsert(make([(n, 1, "old") for n in range(30)] + [(3, 2, "newer"), (None, 1, "none")]), "ingested")
    store.upsert(make([(3, 1, "late"), (4, 5, "new"), (5, 1, "equal"), (99, 1, "added"), (None, 3, "other")]), "ingested")
    found = {r["id"]: r["said"] for r in store.read().collect()}
    assert len(found) == store.read().count() == 32
    assert (found[3], found[4], found[5], found[99], found[None], found[6]) == ("newer", "new", "equal", "added", "other", "old")
    store.replace(make([]), make([(n, 0, "") for n in range(30)]))
    assert {r["id"] for r in store.read().collect()} == {99, None}
    held = files(store.path)
    assert store.clean(1) > 0 and len(files(store.path)) < len(held) and store.versions() == [3]
    assert {r["id"] for r in store.read().collect()} == {99, None}


def test_rows_of_an_update_are_made_once(spark, store):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(book):
        made.add(1)
        return book

    rows = [(n, f"b{n % 20}", f"one two{n} three three") for n in range(60)]
    for book, texts in ((None, rows), ("b3", [(3, "b3", "other words")])):
        made.value = 0
        own = passages(spark, texts)
        store.replace(retrieval.postings(own, "book").withColumn("book", counted.asNondeterministic()("book")), own)
        assert made.value == retrieval.postings(own, "book").count(), book
    assert contents(store) == of(spark, [r for r in rows if r[1] != "b3"] + [(3, "b3", "other words")])


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_dealt_rows_and_shuffled_keys_make_the_same_index(spark, store, monkeypatch, few):
    monkeypatch.setattr(index_store, "KEYS_AT_ONCE", few)
    rows = [(n, f"b{n % 20}" if n % 13 else None, f"one two{n} three three") for n in range(200)]
    own = passages(spark, rows)
    dealt = retrieval.postings(store.deal(own), "book", "_bucket")
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan, plan
    store.replace(dealt, own)
    assert contents(store) == of(spark, rows) and store.read().columns == ["term", "id", "book", "tf"]
    changed = passages(spark, [(1, "b1", "other words"), (2, None, "more")])
    # The counts as another type: what is stored keeps its own.
    store.replace(retrieval.postings(store.deal(changed), "book", "_bucket").withColumn("tf", F.col("tf").cast("int")), changed.unionByName(passages(spark, [(0, "b4", "")])))
    assert contents(store) == of(spark, [r for r in rows if r[1] not in ("b1", "b4", None)] + [(1, "b1", "other words"), (2, None, "more")])
