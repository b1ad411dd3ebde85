"""Data sources in Python: page files by ranges of pages, and the event log with commit and abort."""

import io
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import event_log, page_files, sinks
from corpusloom.sources.readers import OCR_SCHEMA, clean_ocr_words, ocr_words
from corpusloom.streaming import streams

HEADER = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"


def lines(pages, per=7, name="w"):
    return HEADER + "".join(f"5\t{p}\t1\t1\t{n // 3}\t{n}\t{n * 30}\t{p * 9}\t20\t10\t{90 if n % 5 else -1}\t{name}{p}x{n}\n" for p in range(1, pages + 1) for n in range(per))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.tsv").write_text(lines(40, name="ä"))
    (tmp_path / "deep" / "b.tsv").write_text(lines(3))
    (tmp_path / "empty.tsv").write_text(HEADER)
    (tmp_path / "_hidden.tsv").write_text(lines(2))
    (tmp_path / "other.txt").write_text("no table")
    return tmp_path


def test_parts_cover_each_file_once():
    parts = page_files.planned([("a", 10), ("b", 25), ("c", 4), ("d", 6), ("e", 1), ("f", 0)], 10)
    assert [(p.paths, p.share, p.shares) for p in parts if p.shares > 1] == [(["b"], 0, 3), (["b"], 1, 3), (["b"], 2, 3)]
    assert [p.paths for p in parts if p.shares == 1] == [["a"], ["c", "d"], ["e", "f"]]
    assert page_files.planned([], 10) == []


@pytest.mark.parametrize("most", [100, 2000, 1 << 20])
def test_words_are_the_same_however_files_are_cut(spark, folder, most):
    found = page_files.page_files(spark, str(folder), pattern="*.tsv", bytes=str(most))
    assert found.where("error IS NOT NULL").count() == 0
    own = found.where(F.col("path").endswith("/a.tsv")).drop("path", "error")
    plain = spark.read.csv(str(folder / "a.tsv"), sep="\t", header=True, schema=OCR_SCHEMA, quote="")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect()))
    assert found.count() == 43 * 7
    words = clean_ocr_words(own)
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, ocr_words(spark, str(folder / "a.tsv")).collect()))
    assert found.rdd.getNumPartitions() >= (40 * 7 * 30 // most if most < 10_000 else 1)


PICKY = """
class Picky:
    columns = {"page": "int", "letters": "string", "dear": "string"}

    def count(self, file):
        return len(file.read())

    def rows(self, file, first, end, columns):
        if "dear" in columns:
            raise ValueError("too dear")
        for page, letter in list(enumerate(file.read().decode()))[first:end]:
            yield tuple({"page": page, "letters": letter}[c] for c in columns)
"""


def test_a_decoder_is_asked_for_the_columns_of_the_schema(spark, tmp_path):
    (tmp_path / "picky_pages.py").write_text(PICKY)
    spark.sparkContext.addPyFile(str(tmp_path / "picky_pages.py"))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_text("abcdefg")
    made = {"decoder": "picky_pages:Picky", "bytes": "3"}
    found = page_files.page_files(spark, str(tmp_path / "files"), "letters string, page int", **made)
    assert sorted(map(tuple, found.collect())) == [(c, n) for n, c in enumerate("abcdefg")] and found.rdd.getNumPartitions() == 3
    assert {r["error"] for r in page_files.page_files(spark, str(tmp_path / "files"), **made).collect()} == {"too dear"}
    with pytest.raises(Exception, match="no columns"):
        page_files.page_files(spark, str(tmp_path / "files"), "colour string", **made).collect()


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_a_broken_file_is_one_row(spark, folder, most):
    (folder / "bad.tsv").write_bytes((HEADER + "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\tgood\n").encode() + b"5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t90\t\xff\xfe\n")
    (folder / "short.tsv").write_text("a\tb\n1\t2\n")
    found = page_files.page_files(spark, str(folder), "path string, text string, error string", pattern="*.tsv", bytes=str(most))
    broken = {r["path"].rsplit("/", 1)[1]: r["text"] for r in found.where("error IS NOT NULL").collect()}
    assert broken == {"bad.tsv": None, "short.tsv": None}
    assert found.where("error IS NOT NULL").count() == 2 and found.where("error IS NULL").count() == 43 * 7


def test_a_share_reads_its_own_bytes_and_no_more_than_a_line_of_others(tmp_path):
    """Shares that read the file from its start would make the work grow with the square of its size."""
    (tmp_path / "a.tsv").write_text(lines(4000))
    size = (tmp_path / "a.tsv").stat().st_size
    (part,) = {p.shares for p in page_files.planned([("a", size)], 30_000)}
    schema, read, found = pa.schema([("page_num", pa.int32()), ("word_num", pa.int32())]), 0, []

    class Counted(io.FileIO):
        def readinto(self, into):
            nonlocal read
            read += (got := super().readinto(into))
            return got

        def read(self, n=-1):
            nonlocal read
            read += len(got := super().read(n))
            return got

    for share in range(part):
        with Counted(str(tmp_path / "a.tsv")) as file:
            for batch in page_files.OcrTable().batches(file, *page_files.Part(["a"], share, part).range(size), schema):
                found += map(tuple, zip(*(c.to_pylist() for c in batch.columns)))
    assert found == [(p, n) for p in range(1, 4001) for n in range(7)]
    assert part > 20 and read < 3 * size


def test_no_files_no_rows(spark, tmp_path):
    assert page_files.page_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="gone"):
        page_files.page_files(spark, str(tmp_path / "gone")).count()


def test_published_events_are_the_given_ones(spark, tmp_path):
    rows = [(n, f"é{n}\n\n" if n % 7 else None) for n in range(500)]
    event_log.publish(spark.createDataFrame(rows, "id long, message string").repartition(5), str(tmp_path), "one")
    event_log.publish(spark.createDataFrame([], "message string"), str(tmp_path), "none")
    found = event_log.published(spark, str(tmp_path)).collect()
    assert sorted((r["message"] or "") for r in found) == sorted((m or "") for _, m in rows) and {r["channel"] for r in found} == {"one"}
    assert all(len({r["n"] for r in found if r["task"] == t}) == sum(r["task"] == t for r in found) for t in range(5))


def test_a_failing_batch_leaves_no_event(spark, tmp_path):
    event_log.publish(spark.createDataFrame([("kept",)], "message string"), str(tmp_path))
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("message"))
    with pytest.raises(Exception, match="stop"):
        event_log.publish(bad, str(tmp_path))
    assert [r["message"] for r in event_log.published(spark, str(tmp_path)).collect()] == ["kept"]
    # Tasks that were killed leave files that no commit names.
    (tmp_path / "events" / "left.json").write_text('{"task": 0, "n": 0, "message": "ghost"}\n')
    assert [r["message"] for r in event_log.published(spark, str(tmp_path)).collect()] == ["kept"]
    assert event_log.clear_unnamed(spark, str(tmp_path), datetime.now().timestamp() + 60) >= 1
    assert [r["message"] for r in event_log.published(spark, str(tmp_path)).collect()] == ["kept"]


def channels(spark, source):
    own = spark.readStream.schema("kind string, at timestamp, data string").parquet(source)
    merged = streams.merged_events(own.where("kind = 'j'").drop("kind"), own.where("kind = 'b'").drop("kind"))
    return merged.select(F.concat_ws(" ", "kind", "data").alias("message"))


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    """A query that died after its commit and ahead of its checkpoint gives the batch again."""
    source, log, checkpoint = (str(tmp_path / n) for n in ("source", "log", "checkpoint"))

    def add(first):
        rows = [("j" if n % 3 else "b", datetime(2024, 1, 1), str(n)) for n in range(first, first + 40)]
        spark.createDataFrame(rows, "kind string, at timestamp, data string").repartition(4).write.mode("append").parquet(source)

    add(0)
    event_log.publish_stream(channels(spark, source), log, checkpoint, "books").awaitTermination()
    for commit in Path(checkpoint, "commits").iterdir():
        if commit.name.lstrip(".").split(".")[0] == "0":
            commit.unlink()
    add(40)
    event_log.publish_stream(channels(spark, source), log, checkpoint, "books").awaitTermination()
    found = event_log.published(spark, log).collect()
    assert sorted(r["message"] for r in found) == sorted(f"{'job' if n % 3 else 'book'}-update {n}" for n in range(80))
    assert {r["batch"] for r in found} == {0, 1}


RETRIED = """
import sys
from pathlib import Path
from pyspark.sql import functions as F
from corpusloom.session import session
from corpusloom.sources import event_log

folder = Path(sys.argv[1])
spark = session("local[2,4]", **{"spark.ui.enabled": "false"})

def once_broken(batches):
    import pyarrow as pa
    for batch in batches:
        yield batch
        mark = folder / f"mark-{batch.column(0)[0].as_py()}"
        if not mark.exists():  # the first attempt dies with rows on their way
            mark.touch()
            raise RuntimeError("killed")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
rows = spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("message"))
event_log.publish(rows.mapInArrow(once_broken, "message string"), str(folder / "log"))
found = sorted(int(r["message"]) for r in event_log.published(spark, str(folder / "log")).collect())
assert found == list(range(400)), len(found)
print("tries", len(list(folder.glob("mark-*"))), "files", len(list((folder / "log" / "events").iterdir())))
"""


def test_a_task_that_is_tried_again_repeats_nothing(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    # Python keeps none of the test session's settings: a session of its own may try a task four times.
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "tries 8" in done.stdout


def test_messages_pass_through_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'quote " and \\ and \n'), (2, "")], "id long, text string")
    event_log.publish(rows.select(sinks.event_message("job-update", "id", "text").alias("message")), str(tmp_path))
    expected = [r["m"] for r in rows.select(sinks.event_message("job-update", "id", "text").alias("m")).collect()]
    assert sorted(r["message"] for r in event_log.published(spark, str(tmp_path)).collect()) == sorted(expected)
