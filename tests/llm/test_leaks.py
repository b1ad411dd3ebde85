"""Decontamination against full alignment: edits of every kind, common seeds, awkward tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontaminate


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def edited(rng, item, kind, every):
    out = []
    for n, word in enumerate(item):
        hit = n % every == every - 1
        if kind == "replaced":
            out.append("other" + str(rng.randrange(10**6)) if hit else word)
        elif kind == "left out":
            out += [] if hit else [word]
        else:
            out += [word, "more" + str(rng.randrange(10**6))] if hit else [word]
    return out


def full(items, texts, leak=decontaminate.LEAK):
    """Pairs that whole Smith-Waterman alignment reports."""
    vocabulary = {}
    number = lambda ws: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int64)
    own, passages = [number(decontaminate.words_of(t or "")) for t in items], [number(decontaminate.words_of(t or "")) for t in texts]
    return {(n, k) for n, p in enumerate(passages) for k, i in enumerate(own) if len(i) > 3 and decontaminate.smith_waterman(i, p)[0] >= leak * 2 * len(i)}


@pytest.mark.parametrize("size", [60, 400, 20_000])
def test_edits_against_full_alignment(spark, size):
    rng = random.Random(size)
    items, texts = [], []
    for kind in ("replaced", "left out", "put in"):
        for every in range(1, 9):
            for _ in range(4):
                own = words(rng, rng.choice([5, 12, 24, 38]), size)
                items.append(" ".join(own))
                texts.append(" ".join([*words(rng, 30, size), *edited(rng, own, kind, every), *words(rng, 30, size)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = full(items, texts)
    assert len({n for n, k in expected if n == k}) > 60  # the other edits take away too much
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == expected
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == set(range(len(texts))) - {n for n, _ in expected}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=4, max_size=14), st.lists(st.integers(0, 9), max_size=40), st.sampled_from([0.3, 0.5, 0.8]))
def test_no_leak_without_its_seeds(item, passage, leak):
    block = decontaminate.Benchmark.of([(0, " ".join(f"w{n}" for n in item))], leak)
    own = np.array([block.vocabulary.get(f"w{n}", -1) for n in passage] + [-1, -1], dtype=np.int64)
    block.seed(block.counts_in(own))
    score = decontaminate.smith_waterman(block.items[0], own[:-2])[0]
    found = block.leaks(own, np.array([0, len(own)]))
    if decontaminate.seeds_needed(len(item), leak)[0]:
        assert bool(found) == (score >= leak * 2 * len(item))
        assert not found or found[0][2] == score / (2 * len(item))


def test_short_items_and_awkward_rows(spark):
    rng = random.Random(4)
    item = words(rng, 20)
    long = " ".join([*["filler"] * 60_000, *item, *words(rng, 60_000, 20_000)])
    rows = [(1, "a first second b", "x", 5), (1, "first other second", "x", 5), (None, " ".join(item), "x", 5), (None, " ".join(item), "x", 5), (2, long, "x", 5), (3, None, None, None), (4, "", "", 0), (5, "single words", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame([(7, "first second", 1), (8, " ".join(item), 1), (8, " ".join(item), 1), (9, "", 1), (10, None, 1), (11, "Single", 1)], "item_id long, text string, doc_id int")
    found = sorted(((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert found == sorted([(1, 7, 1.0), *[(None, 8, 1.0)] * 4, *[(2, 8, 1.0)] * 2, (5, 11, 1.0)], key=str)
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and sorted((tuple(r) for r in left.collect()), key=str) == sorted([rows[1], rows[5], rows[6]], key=str)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    rng = random.Random(5)
    items = [words(rng, 20) for _ in range(12)]
    docs = spark.createDataFrame([(n, " ".join([*words(rng, 9), *items[n % 12], *words(rng, 9)])) for n in range(24)] + [(24, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(n, n % 12) for n in range(24)}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()] == [24]
