"""The cell index against a scan, and ranking with typos and proximity against plain programs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import ranking, vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 30, 4000)
    label[:1400] = 0  # one cell holds a third
    rows = rng.normal(size=(30, 24))[label] * 2 + rng.normal(size=(4000, 24)) * 0.6
    rows[2000:2400] = rows[2000]  # one vector many times
    named = [(f"p{n}", row.tolist(), int(n % 3)) for n, row in enumerate(rows)]
    return spark.createDataFrame([*named, ("none", None, 0), ("zero", [0.0] * 24, 1)], "id string, vector array<double>, tenant int").repartition(6).persist()


def brute(asked, points, k, scope=False):
    rows = [(r["id"], np.array(r["vector"]), r["tenant"]) for r in points.collect() if r["vector"] is not None and any(r["vector"])]
    unit = np.array([v / np.sqrt(v @ v) for _, v, _ in rows])
    out = {}
    for q in asked.collect():
        if q["vector"] is None or not any(q["vector"]):
            continue
        v = np.array(q["vector"])
        scores = np.round(unit @ (v / np.sqrt(v @ v)), 6)
        best = sorted((-s, i) for s, (i, _, tenant) in zip(scores.tolist(), rows) if not scope or tenant == q["tenant"])[:k]
        out |= {(q["q"], n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("scope", [None, "tenant"])
def test_indexed_search_is_the_scan(points, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(vectors, "FILE_POINTS", 100)
    monkeypatch.setattr(vectors, "SCORES_AT_ONCE", 5000)
    asked = points.where("id like '%77' or id in ('none', 'zero')").select(F.col("id").alias("q"), "vector", "tenant")
    index = vectors.build(points, str(tmp_path / "index"))
    assert int(index.sizes.sum()) == 4002 and len(list((tmp_path / "index" / "points").glob("cell=*/*.parquet"))) > len(index.centres)
    as_map = lambda df: {(r["q"], r["rank"]): (r["id"], round(r["score"], 6)) for r in df.collect()}
    expected = brute(asked, points, 10, scope is not None)
    assert as_map(vectors.nearest(asked, points, 10, scope)) == expected
    found, share = vectors.search(asked, index, 10, scope=scope, full_scan=0)
    assert as_map(found) == expected and share < 0.6
    assert as_map(vectors.search(asked, vectors.opened(points.sparkSession, index.path), 10, scope=scope)[0]) == expected  # few points: scanned


def test_probed_search_recalls_what_was_asked_for(points, tmp_path):
    asked = points.where("id like '%3'").select(F.col("id").alias("q"), "vector")
    index = vectors.build(points, str(tmp_path / "index"))
    found, share = vectors.search(asked, index, exact=False, full_scan=0)
    recall = vectors.recall(found, vectors.nearest(asked, points)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.93 and share < 0.5
    worse, less = vectors.search(asked, index, exact=False, probes=1, full_scan=0)
    assert less < share and vectors.recall(worse, vectors.nearest(asked, points)).agg(F.avg("recall")).first()[0] <= recall


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<float>")
    index = vectors.build(none, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vector array<float>")
    assert vectors.search(asked, index)[0].count() == 0 and vectors.nearest(asked, none).count() == 0
    assert vectors.nearest(asked.where("false"), asked.withColumnRenamed("q", "id")).count() == 0


def test_questions_in_blocks(points, monkeypatch):
    asked = points.where("id like '%7'").select(F.col("id").alias("q"), "vector", "tenant")
    whole = vectors.nearest(asked, points, 5).collect()
    monkeypatch.setattr(vectors, "QUESTIONS_AT_ONCE", 60)
    assert sorted(vectors.nearest(asked, points, 5).collect()) == sorted(whole)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def most(word):
    return 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0


def corpus(rng):
    base = ["market", "merchant", "contracts", "obligation", "price", "sale", "witness", "testimony"]

    def bent(word):
        word = list(word)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            rng.choice([lambda: word.pop(at), lambda: word.insert(at, rng.choice("abcxyz")), lambda: word.__setitem__(at, rng.choice("abcxyz"))])()
            word[:] = word or ["a"]
        return "".join(word)

    texts = [" ".join(rng.choice([bent(rng.choice(base)), rng.choice(base), "filler", "Other,", "--"]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return [*texts, "", texts[0], texts[0], None]


def test_ranked_leg_is_that_of_a_plain_program(spark):
    rng = random.Random(11)
    texts = corpus(rng)
    questions = {1: "the market price of contracts", 2: "obligation witness", 3: "merchant", 4: "testimny contrakts", 5: "zzzzzz", 6: "the of"}
    passages = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, text string").repartition(3)
    asked = spark.createDataFrame(list(questions.items()), "q long, question string")
    found = {}
    for r in ranking.ranked_leg(asked, ranking.positional_postings(passages), 8).collect():
        found.setdefault(r["q"], {})[r["rank"]] = (r["id"], r["tier"], r["matched"], r["typos"], r["span"], r["tf"])
    words = {n: [w.strip(".,-").lower() for w in re.split(r"\s+", t or "")] for n, t in enumerate(texts)}
    for q, question in questions.items():
        terms = sorted({w for w in question.split() if w not in ("the", "of")})
        held = {}  # by passage the typos and positions of each word
        for n, own in words.items():
            for term in terms:
                near = [(distance(term, w), p) for p, w in enumerate(own) if w and distance(term, w) <= most(term)]
                if near:
                    held.setdefault(n, {})[term] = (min(near)[0], [p for _, p in near])
        df = {t: sum(t in h for h in held.values()) for t in terms}
        order = sorted((t for t in terms if df[t]), key=lambda t: (df[t], t))
        rows = []
        for n, own in held.items():
            tier = next((k for k, t in enumerate(order) if t not in own), len(order))
            span = 0
            if len(own) > 1:
                marks = sorted((p, t) for t, (_, ps) in own.items() for p in ps)
                span = min(marks[b][0] - marks[a][0] for a in range(len(marks)) for b in range(a, len(marks)) if len({t for _, t in marks[a : b + 1]}) == len(own))
            rows.append((-tier, -len(own), sum(t for t, _ in own.values()), span, -sum(len(p) for _, p in own.values()), n))
        expected = {k: (n, -tier, -matched, typos, span, -tf) for k, (tier, matched, typos, span, tf, n) in enumerate(sorted(rows)[:8], 1)}
        assert found.get(q, {}) == expected, q


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.text(alphabet="abcé", min_size=1, max_size=12), min_size=1, max_size=12))
def test_variants_are_all_words_within_the_typos(spark, asked, vocabulary):
    found = ranking.variants(spark.createDataFrame([(w,) for w in asked], "asked string"), spark.createDataFrame([(w,) for w in vocabulary], "term string"))
    expected = {(a, w, distance(a, w)) for a in asked for w in vocabulary if distance(a, w) <= most(a)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
