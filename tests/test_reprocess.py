"""Books done again: catalogue and jobs, running work, and what is stored of them."""

import time
from pathlib import Path

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from corpusloom.plans import ingest, reprocess

BOOKS = "book long, tenant string, status string, total_chunks int, total_pages int, title string"
JOBS = "job string, book long, tenant string, status string, task_id string, progress int"


@pytest.fixture
def catalogue(spark):
    books = spark.createDataFrame([(1, "a", "ready", 7, 3, "x"), (2, "a", "failed", 0, None, None), (3, "b", "ready", 5, 2, "z"), (4, "a", "ready", 1, 1, "w"), (None, "a", "ready", 1, 1, "n")], BOOKS)
    jobs = spark.createDataFrame([("j1", 1, "a", "completed", "t1", 100), ("j2", 1, "a", "extracting", "t2", 10), ("j3", 3, "b", "queued", "t3", 0), ("j4", 2, "a", "failed", None, 50), ("j5", 4, "a", "queued", None, 0)], JOBS)
    return books, jobs


def test_reprocessing_sets_books_back_and_queues_one_job_each(spark, catalogue):
    books, jobs = catalogue
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (99,), (None,)], "book long")  # 3 is another tenant's, 99 is none
    changed = reprocess.reprocessed(books, jobs, asked, "a", "monday")
    assert {tuple(r) for r in changed.books.collect()} == {(1, "a", "pending", 0, None, "x"), (2, "a", "pending", 0, None, None), (3, "b", "ready", 5, 2, "z"), (4, "a", "ready", 1, 1, "w"), (None, "a", "ready", 1, 1, "n")}
    found = {r["job"]: r for r in changed.jobs.collect()}
    new = [r for j, r in found.items() if j not in ("j3", "j5")]
    assert {"j3", "j5"} < set(found) and sorted((r["book"], r["tenant"], r["status"], r["task_id"], r["progress"]) for r in new) == [(1, "a", "queued", None, None), (2, "a", "queued", None, None)]
    assert {r[0] for r in changed.revoked.collect()} == {"t1", "t2"}
    same = reprocess.reprocessed(books, jobs, asked, "a", "monday").jobs
    assert {r["job"] for r in same.collect()} == set(found) and changed.books.columns == books.columns and changed.jobs.columns == jobs.columns


def test_removing(spark, catalogue):
    changed = reprocess.removed(*catalogue, spark.createDataFrame([(1,), (3,)], "book long"), "a")
    assert {r["book"] for r in changed.books.collect()} == {2, 3, 4, None} and {r["job"] for r in changed.jobs.collect()} == {"j3", "j4", "j5"}
    empty = reprocess.removed(*catalogue, spark.createDataFrame([], "book long"), "a")
    assert empty.books.count() == 5 and empty.jobs.count() == 5 and empty.revoked.count() == 0


def test_a_revoked_task_stops(spark):
    ended = []

    def work():
        with reprocess.as_task(spark, "slow"):
            try:
                spark.range(0, 4, 1, 4).select(F.call_function("java_method", F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(40_000).cast("long"))).collect()
                ended.append("done")
            except Exception as reason:
                ended.append(str(reason))

    thread = InheritableThread(target=work)
    thread.start()
    began = time.time()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 20:
        time.sleep(0.1)
    reprocess.revoke(spark, ["other"])
    time.sleep(1)
    assert not ended
    reprocess.revoke(spark, ["slow"])
    thread.join(20)
    assert ended and ended[0] != "done" and "cancelled" in ended[0]
    assert spark.range(3).count() == 3


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, text string")


def lines(doc, page, word="word"):
    return "\n".join(f"{word}{doc} line {n} of page {page} goes on for some words more" for n in range(25)) + f"\n{page}"


def rows(found, *columns):
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def test_only_the_documents_asked_for_are_made_anew(spark, tmp_path):
    first = [(d, p, lines(d, p)) for d in range(6) for p in range(1, 4)]
    indexes = reprocess.Indexes.at(spark, str(tmp_path), 16)
    every = spark.createDataFrame([(d,) for d in range(6)], "doc_id long")
    counts = {r["doc_id"]: (r["total_pages"], r["total_chunks"]) for r in reprocess.reingested(indexes, texts(spark, first), every).collect()}
    assert set(counts) == set(range(6)) and all(pages == 3 and chunks > 0 for pages, chunks in counts.values())
    files = {p: p.read_bytes() for p in Path(tmp_path).rglob("*.parquet")}
    # Document 2 has other pages now, 3 has none, 4 has changed too but is not asked for.
    second = [(d, p, lines(d, p, "other" if d in (2, 4) else "word")) for d in range(6) for p in range(1, 3 if d == 2 else 4) if d != 3]
    asked = spark.createDataFrame([(2,), (3,), (77,)], "doc_id long")
    counts = {r["doc_id"]: (r["total_pages"], r["total_chunks"]) for r in reprocess.reingested(indexes, texts(spark, second), asked).collect()}
    assert counts[3] == counts[77] == (0, 0) and counts[2][0] == 2
    whole = [r for r in first if r[0] not in (2, 3)] + [r for r in second if r[0] == 2]
    fresh = reprocess.Indexes.at(spark, str(tmp_path / "fresh"), 16)
    reprocess.reingested(fresh, texts(spark, whole), every)
    assert rows(indexes.passages.read(), "doc_id", "chunk_no", "text") == rows(fresh.passages.read(), "doc_id", "chunk_no", "text") == rows(ingest.passages(texts(spark, whole)), "doc_id", "chunk_no", "text")
    assert rows(indexes.postings.read(), "term", "id", "tf") == rows(fresh.postings.read(), "term", "id", "tf")
    assert rows(indexes.vectors.read(), "id", "doc_id") == rows(fresh.vectors.read(), "id", "doc_id")
    assert all(p.read_bytes() == known for p, known in files.items())
    again = reprocess.reingested(indexes, texts(spark, second), asked)
    assert again.count() == 3 and rows(indexes.postings.read(), "term", "id", "tf") == rows(fresh.postings.read(), "term", "id", "tf")
