"""Operators that drop rows: exactly the right ones, whatever the ids are."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language_id, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, at timestamp, part array<int>"


def table(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", s, n, "d", "r", None, [n]) for n, (i, t, s) in enumerate(rows)], SCHEMA).repartition(3)


def left(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 900])
def test_drop_copies(spark, table_bytes):
    rows = [(5, "x y", "a"), (5, "xy", "a"), (5, "unique", "a"), (3, "other", "a"), (None, "q", "a"), (None, "q", "b"), (7, "z", "a"), (7, "z", "a"), (None, None, "a"), (None, "", "a"), (9, " ", "a"), (None, "only", None)]
    rows += [(n % 3 or None, f"text {n % 40} " + "long " * 30, "h") for n in range(300)]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    expected = Counter()
    for group in groups.values():
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        expected[best[:2]] += 1
    docs = table(spark, rows)
    found = exact_dedup.drop_copies(docs, table_bytes)
    assert found.schema == docs.schema and left(found) == expected
    assert sorted(r["n_chars"] for r in found.collect()) == sorted(r["n_chars"] for r in exact_dedup.drop_copies(docs.repartition(2), table_bytes).collect())


def test_drop_near_copies(spark):
    rng = random.Random(1)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4))
    near = b.replace(b.split()[30], "changed")
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (2, c, "s"), (2, a.upper(), "s"), (None, b, "s"), (None, near, "t"), (4, d, "s"), (4, d, "s"), (4, d, "s"), (None, None, None), (None, "", None), (6, "!!!", None)]
    docs = table(spark, rows)
    found = near_dedup.drop_near_copies(docs)
    assert found.schema == docs.schema
    kept = left(found)
    assert kept[1, a] == kept[2, c] == kept[4, d] == kept[6, "!!!"] == 1 and kept[None, b] + kept[None, near] == 1
    assert kept[None, None] + kept[None, ""] == 1 and sum(kept.values()) == 6
    numbers = [sorted(r["n_chars"] for r in near_dedup.drop_near_copies(docs.repartition(n)).collect()) for n in (1, 4)]
    assert numbers[0] == numbers[1]


def test_drop_near_copies_of_a_hot_row_without_id(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(50)]
    rows = [(None, texts[n if n < 50 else 0], "s") for n in range(150)]
    assert left(near_dedup.drop_near_copies(table(spark, rows))) == Counter({(None, t): 1 for t in texts})


def test_keep_known(spark):
    rng = random.Random(3)
    speech = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "und", "nicht", "schön", "über"]}
    rows = [(n, " ".join(rng.choices(speech["de" if n % 2 else "en"], k=30)), "de" if n % 2 else "en", "h") for n in range(120)]
    rows += [(1, "漢字" * 50, None, None), (None, "漢字" * 50, None, None), (None, "the thing and the other", None, None), (None, "the thing and the other", None, None), (3, None, None, None), (None, "", None, "h"), (None, "über nicht und " * 9000, None, "h")]
    docs = spark.createDataFrame([(*r, n, "x") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, text_log string").withColumn("declared", F.lit("zz"))
    found = language_id.keep_known(docs)
    assert found.schema == docs.schema
    assert sorted(r["n_chars"] for r in found.collect()) == [*range(120), 122, 123, 125, 126]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for made in (exact_dedup.drop_copies(docs), near_dedup.drop_near_copies(docs), language_id.keep_known(docs)):
        assert made.schema == docs.schema and made.count() == 0


def test_recall_against_all_pairs(spark):
    """Links between different texts of a corpus, against the alignment of all pairs."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {}
    for r in docs.collect():
        texts.setdefault(tuple(near_dedup.words_of(r["text"] or "")), r["doc_id"])
    words = [np.array(near_dedup.word_hashes(list(t), {}), dtype=np.uint32) for t in texts]
    ids, lengths = list(texts.values()), np.array([len(w) for w in words])
    bins = np.array([near_dedup._bins(w) for w in words])
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    links = found = 0
    for n in range(len(words)):
        longer = np.maximum(lengths[n + 1 :], lengths[n])
        apart = bins[n + 1 :] - bins[n]
        least = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        for k in np.flatnonzero(least <= 0.2 * longer) + n + 1:
            if lengths[n] and near_dedup.similar(words[n], words[k]):
                links += 1
                found += classes[ids[n]] == classes[ids[k]]
    print(f"{found} of {links} links")
    assert links > 30 and found >= 0.9 * links
