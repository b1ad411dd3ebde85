"""Each operator against brute force or an exact round trip, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import blocks, bpe, decontaminate, exact_dedup, hmm, language_id, license_scan, near_dedup, quality, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, block long, words string, key string, size int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empties, repeated rows and a very long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randrange(8, 120)) for _ in range(40)]
    texts = [*base, *base[:6], *(t.replace(" ", "\n ", 3) for t in base[:3])]
    for t in base[10:18]:
        own = t.split()
        own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    passage = words(rng, 30)
    texts += [f"{words(rng, 20)} {passage} {words(rng, 5)}" for _ in range(5)]
    texts += ["", None, " \n\t", "a", "!!!", "???", words(rng, 9000), "é" * 60, "<|endoftext|>x <|endoftext|>", "A B ć Straße"]
    rows = [(n, t, "en" if n % 3 else "de", "s0" if n % 2 else None, None, "d", 7, "w", "k", 1) for n, t in enumerate(texts)]
    return [*rows, rows[2], (None, base[4], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def better(row):
    return (-len(row[1] or ""), row[0] is None, row[0] or 0)


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 2000])
def test_exact_dedup(docs, rows, table_bytes):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    expected = Counter()
    for text, group in groups.items():
        keep = min(group, key=better)[0]
        for r in group:
            expected[r[0], keep, len(group), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    for few in (exact_dedup.FEW_KEYS, 0):
        assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, table_bytes, few).collect()) == expected


def test_grace_recursion(tmp_path):
    records = [(hashlib.sha256(b"%d" % (n % 500)).digest(), b"%d" % (n % 500) * 50, n % 7, n, 1) for n in range(3000)]
    found = {e[1]: (e[3], e[4]) for e in exact_dedup.grace(iter(records), tmp_path, table_bytes=3000)}
    for n in range(500):
        own = [r for r in records if r[1] == b"%d" % n * 50]
        assert found[own[0][1]] == (min(own, key=lambda r: (-r[2], r[3]))[3], len(own))


def test_sharding(docs, rows):
    found = sharding.shard(docs, n_shards=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_sharding_balance_with_a_hot_text(spark):
    table = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', repeat(cast(id AS string), 1 + id % 9)) AS text")
    sizes = Counter()
    for r in sharding.shard(table, n_shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_is_the_tokenizers(docs, rows, tokenizer_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    expected = Counter()
    for r in rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        expected[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode_digests(docs, tokenizer_path).collect()) == expected


def test_bpe_over_several_blocks(docs, rows, tokenizer_path, monkeypatch):
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda table: pack(table, block_bytes=700))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    expected = Counter((r[0], tuple(own.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, tokenizer_path).collect()) == expected


def brute_spans(rows):
    last = 1 << 62
    texts = [(last if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for own, _, text in texts:
        for p in range(len(text) - 49):
            first[text[p : p + 50]] = min(own, first.get(text[p : p + 50], last + 1))
    out = Counter()
    for own, doc_id, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < own:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(text)) if gone[p] and (not p or not gone[p - 1]))
        out[doc_id, len(text), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(text, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot_contexts", [suffix_dedup.HOT_CONTEXTS, 3, 0])
@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 900])
def test_suffix_dedup(docs, rows, block_bytes, hot_contexts):
    assert Counter(tuple(r) for r in suffix_dedup.repeated_spans(docs, block_bytes, hot_contexts).collect()) == brute_spans(rows)


def test_suffix_dedup_deals_hot_anchors(spark):
    phrase = "the very same phrase of the whole corpus"
    rows = [(n, f"{n * 7919 % 1000:05d} {n % 11} words before {phrase} words after {n % 7} {n * 104729 % 1000:05d}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_spans(rows)
    assert sum(n for _, _, n, _, _ in expected.elements()) > 10000
    for hot in (5, suffix_dedup.HOT_CONTEXTS):
        assert Counter(tuple(r) for r in suffix_dedup.repeated_spans(docs, 2000, hot).collect()) == expected


def test_kept_bytes_match_their_digest(docs):
    kept = Counter(hashlib.sha256(bytes(r["text"])).hexdigest() for r in suffix_dedup.remove_repeats(docs).collect())
    assert kept == Counter(r["kept_sha256"] for r in suffix_dedup.repeated_spans(docs).collect())


def test_strings_of_a_hot_anchor_are_spread():
    import pyarrow as pa

    phrase = "the very same phrase of the whole corpus"
    texts = [f"{n * 7919 % 1000:05d} {phrase} {n * 104729 % 1000:05d}".encode() for n in range(200)]
    table, parts = pa.table({"doc_id": list(range(200)), "text": pa.array(texts, pa.binary())}), 16
    asked = list(suffix_dedup._questions(table, parts))
    largest = []
    for said in (1, 2):  # every anchor is known elsewhere; and is hot besides
        answers = [(bucket, given[:4] + bytes([said]) * ((len(given) - 4) // 2)) for bucket, _, given in asked]
        sent = [r for r in suffix_dedup._contexts(0, table, answers).to_pylist() if r["bucket"] >= 0]
        sizes = [len(blocks.unsqueeze(r["given"])) // suffix_dedup._CONTEXT.itemsize for r in sent]
        largest.append((max(sizes) / sum(sizes), len(sizes)))
    assert largest[0][0] > 0.2 > 2 * largest[1][0] and largest[1][1] == parts, largest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=50, max_size=70).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=12))
def test_deep_shallow_sorts(parts):
    parts = parts + parts[:2]
    buffer = np.frombuffer(b"".join(parts) + bytes(40), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    order, rank = suffix_dedup.deep_shallow(buffer, starts, lengths)
    assert [parts[k] for k in order] == sorted(parts, key=lambda p: p.ljust(70, b"\0") + bytes([len(p) - 24 & 255]))
    assert all((rank[a] == rank[b]) == (parts[a] == parts[b]) for a in range(len(parts)) for b in range(len(parts)))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a):
        new = [n + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_distance(a, b, most):
    assert near_dedup.edit_distance(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), most) == min(plain_distance(a, b), most + 1)


def test_near_dedup(docs, rows):
    texts = {}
    for r in rows:
        own = tuple(decontaminate.words_of(r[1] or ""))
        texts.setdefault(own or (r[1] or "",), []).append(r[0])
    keys = list(texts)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            longer = max(len(a), len(b))
            if longer < 3000 and len(a) > 1 and len(b) > 1 and abs(len(a) - len(b)) * 5 <= longer and plain_distance(a, b) * 5 <= longer:
                root[find(b)] = find(a)
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)] += texts[k]
    expected = Counter()
    for group in groups.values():
        least = min((x for x in group if x is not None), default=None)
        for x in group:
            expected[x, least, len(group), x == least] += 1
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == expected


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    rng = random.Random(9)
    common = words(rng, 40)
    texts = [f"{common} {words(rng, 45, 90000)}" for _ in range(30)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted((n, n % 30) for n in range(60))
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(table).collect()) == expected


def test_quality_keeps_the_share_of_labels_where_the_sample_is_capped(spark):
    rng = random.Random(13)
    table = spark.createDataFrame([(n, words(rng, 40)) for n in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 7 > 0)) for n in range(900)], "doc_id long, quality int")
    found = [r["score"] for r in quality.score(table, quality.fit(table, labels, rows=60)).collect()]
    assert sum(found) / len(found) > 0.75


@pytest.mark.parametrize(("bound", "value"), [("BUCKET", 4), ("BUCKET_WORDS", 200)])
def test_giant_buckets_against_brute_force(spark, monkeypatch, bound, value):
    monkeypatch.setattr(near_dedup, bound, value)
    rng = random.Random(10)
    texts = []
    for _ in range(4):
        own = words(rng, 60, 90000).split()
        for n in range(5):  # each is near the one before; from the third on, not near the first
            own[n * 8 : n * 8 + 8] = words(rng, 8, 90000).split()
            texts.append(" ".join(own))
    digests = [near_dedup._digest(t.split(), t) for t in texts]
    hashes = [near_dedup.word_hashes(t.split(), {}) for t in texts]
    near = lambda a, b: near_dedup.similar(hashes[a], hashes[b], near_dedup.SIMILARITY)
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    packed = table.mapInArrow(near_dedup._words, near_dedup._WORDS)
    members = spark.createDataFrame([("k", len(texts), 60 * len(texts), 60, bytearray(digests[2]), bytearray(d)) for d in digests], "key string, size long, bucket_words long, n_words long, leader binary, digest binary")
    checked = spark.createDataFrame([(bytearray(digests[2]), bytearray(d), near(2, n)) for n, d in enumerate(digests) if n != 2], "leader binary, member binary, linked boolean")
    links = {(digests.index(bytes(r["leader"])), digests.index(bytes(r["member"]))) for r in near_dedup._remaining(members, checked, packed, near_dedup.SIMILARITY).collect()}
    links |= {(2, n) for n in range(len(texts)) if n != 2 and near(2, n)}

    def classes(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(n for n in range(len(texts)) if root[n] == r) for r in root}

    assert all(near(a, b) for a, b in links)
    assert classes(links) == classes([(a, b) for a in range(len(texts)) for b in range(a) if near(a, b)])


def test_components(spark):
    edges = spark.createDataFrame([(bytearray([n]), bytearray([n + 1])) for n in range(1, 60) if n % 10], "a binary, b binary")
    found = {r["node"][0]: r["root"][0] for r in near_dedup.components(edges).collect()}
    for n in range(1, 60):
        if n % 10:
            assert found.get(n, n) == found.get(n + 1, n + 1) == (n // 10 * 10 + 1)


def plain_local(item, passage):
    best, row = 0, [0] * (len(passage) + 1)
    for x in item:
        new = [0]
        for k, y in enumerate(passage):
            new.append(max(0, row[k] + (2 if x == y else -1), row[k + 1] - 1, new[k] - 1))
        row = new
        best = max(best, *row)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=10), st.lists(st.integers(0, 3), max_size=14))
def test_smith_waterman(item, passage):
    assert decontaminate.smith_waterman(np.array(item, dtype=np.int64), np.array(passage, dtype=np.int64))[0] == plain_local(item, passage)


def test_decontamination_against_full_alignment(spark):
    rng = random.Random(2)
    items = [(n, words(rng, 24)) for n in range(12)] + [(12, ""), (13, None), (14, "w1x w2x")]
    texts = []
    for n in range(60):
        own = items[n % 12][1].split()
        if n % 4 == 1:
            own[::6] = ["edited"] * len(own[::6])
        if n % 4 == 2:
            own[5:5] = ["put", "in"]
        texts.append(f"{words(rng, 30)} {' '.join(own) if n % 4 < 3 else ''} {words(rng, 30)}")
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for n, text in enumerate(texts):
        for k, item in items[:12]:
            own, passage = decontaminate.words_of(item), decontaminate.words_of(text)
            if plain_local(own, passage) >= decontaminate.LEAK * 2 * len(own):
                expected.add((n, k))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {x for x in found if x[1] < 12} == expected and {(n, n % 12) for n in range(60) if n % 4 < 3} <= found
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert clean == set(range(62)) - {x[0] for x in found}


def test_decontamination_of_copies_in_hundreds_of_documents(spark):
    rng = random.Random(12)
    edited, partial = words(rng, 38, 5000).split(), words(rng, 40, 5000)
    item = " ".join(edited)
    for n in (9, 19, 29):
        edited[n] = "changed"
    texts = [f"{words(rng, 20)} {' '.join(edited)} {words(rng, 5)}" for _ in range(300)]
    texts += [f"{words(rng, 20)} {' '.join(partial.split()[:26])} {words(rng, 5)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, partial)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(n, n // 300) for n in range(600)}
    assert decontaminate.drop_leaks(docs, bench).count() == 0


def brute_hmm(p, sequence):
    v, log = None, 0.0
    for n, c in enumerate(sequence):
        v = (p.initial if n == 0 else v @ p.transition) * p.emission[:, c]
        log += np.log(v.sum())
        v = v / v.sum()
    return log


def brute_expected(p, sequence):
    """Counts by the forward and backward vectors of every place, one place at a time."""
    n = len(sequence)
    alpha, beta = np.zeros((n, hmm.STATES)), np.ones((n, hmm.STATES))
    for t, c in enumerate(sequence):
        alpha[t] = (p.initial if t == 0 else alpha[t - 1] @ p.transition) * p.emission[:, c]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = p.transition @ (p.emission[:, sequence[t + 1]] * beta[t + 1])
        beta[t] /= beta[t].sum()
    moves, emitted = np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
    for t, c in enumerate(sequence):
        gamma = alpha[t] * beta[t]
        emitted[:, c] += gamma / gamma.sum()
        if t:
            both = alpha[t - 1][:, None] * p.transition * (p.emission[:, c] * beta[t])[None, :]
            moves += both / both.sum()
    first = alpha[0] * beta[0]
    return np.concatenate([first / first.sum(), moves.ravel(), emitted.ravel()])


def random_parameters(rng):
    counts = rng.random(hmm.N_CELLS)
    return hmm.Parameters.from_counts(counts)


def test_hmm_recursions():
    rng = np.random.default_rng(1)
    p = random_parameters(rng)
    sequences = [rng.integers(0, hmm.CLASSES, n) for n in (1, 3, hmm.SEGMENT, hmm.SEGMENT + 1, 2 * hmm.SEGMENT + 5, 700)]
    segments = hmm.Segments(sequences)
    assert np.allclose(segments.likelihoods(p), [brute_hmm(p, s) for s in sequences])
    counts = segments.expected(p)
    assert np.allclose(counts, sum(brute_expected(p, s) for s in sequences))
    assert np.allclose(segments.log, segments.likelihoods(p)) and np.isclose(hmm.p_total(counts), sum(map(len, sequences)))
    better = hmm.Parameters.from_counts(counts)
    assert segments.likelihoods(better).sum() > segments.likelihoods(p).sum()


def test_hmm_starts_from_pairs():
    """Two kinds of words that alternate are told apart."""
    pairs = np.zeros((8, 8))
    pairs[:4, 4:], pairs[4:, :4] = 50, 50
    log, share, transition, emission = max(hmm.fit_pairs(pairs, seed) for seed in range(3))
    assert log > 1600 * np.log(1 / 32) - 20 and np.allclose(emission.sum(axis=1), 1) and np.isclose(share.sum(), 1)
    kinds = emission[:, :4].sum(axis=1)
    assert ((kinds > 0.95) | (kinds < 0.05)).all()


def test_language_model_scores_by_brute_force(docs, rows):
    coded, vocabulary = hmm.coded(docs)
    p = hmm.train(coded, vocabulary, 2)
    counts = Counter(t for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1 for t in (r[1] or "").encode().lower().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[: hmm.TOP]
    assert list(vocabulary.top) == top
    tokens, kinds = Counter(), Counter()
    for w in set(counts) - set(top):
        tokens[hmm.shared_class(w)] += counts[w]
        kinds[hmm.shared_class(w)] += 1
    expected = Counter()
    for r in rows:
        own, within = [], 0.0
        for w in (r[1] or "").encode().lower().split():
            if w in vocabulary.top:
                own.append(top.index(w))
            else:
                own.append(c := hmm.shared_class(w))
                within += np.log10((counts[w] + 0.5) / (tokens[c] + 0.5 * (kinds[c] + 1)))
        expected[r[0], round(brute_hmm(p, [*own, hmm.END]) / np.log(10) + within, 3)] += 1
    found = coded.mapInArrow(hmm._scorer(p, vocabulary.tokens), hmm.SCORES).collect()
    assert Counter((r["doc_id"], round(r["score"], 3)) for r in found) == expected


def test_language_model(docs, rows):
    held = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1
    tokens = [[*re.findall(rb"[^\x20\x09-\x0d]+", (r[1] or "").encode().lower()), None] for r in rows]
    counts = Counter(t for r, own in zip(rows, tokens) if not held(r) for t in own)
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r, own in zip(rows, tokens):
        base = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        expected[r[0], held(r), len(own), sum(counts[t] > 0 for t in own), n, round(base, 4)] += 1
    found = hmm.language_model_scores(docs, iterations=1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)


def test_quality_learns(spark):
    rng = random.Random(3)
    texts = [words(rng, 150) if n % 2 else " ".join(f"{rng.choice('|%#')} z{rng.randrange(50)}" for _ in range(150)) for n in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (400, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(400)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(found) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    tested = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert {r["doc_id"] for r in tested} == {n for n in range(400) if zlib.crc32(str(n).encode()) % 3 == 1}
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in tested) > 0.95 * len(tested)
    again = quality.score(docs, quality.fit(docs, labels.where("doc_id % 3 <> 7")))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["score"]) for r in found)


def test_quality_sizes_and_scores(spark):
    """Evidence and scores as plain zstandard gives them."""
    import math

    import zstandard

    rng = random.Random(14)
    texts = [words(rng, rng.randrange(1, 400)) if n % 2 else "| ".join(f"z{rng.randrange(30)}" for _ in range(80)) for n in range(200)]
    rows = [*enumerate(texts), (7, "other text of a repeated id"), (None, "x"), (900, None), (901, ""), (902, words(rng, 60_000))]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(150)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model == quality.fit(docs.repartition(5), labels.repartition(3))

    def size(text, data):
        own = zstandard.ZstdCompressionDict(data) if data else None
        total = 0
        for n in range(0, max(len(text), 1), 512):
            made = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(made.compress(text[n : n + 512]))
        return total

    found = Counter((r["doc_id"], round(r["score"], 9)) for r in quality.score(docs, model).collect())
    expected = Counter()
    for i, t in rows:
        own = (t or "").encode()
        plain, good, bad = (size(own, d) for d in (b"", model.good, model.bad))
        z = model.weights[0] + model.weights[1] * (bad - good) / plain + model.weights[2] * (bad - good) / (len(own) + 64)
        expected[i, round(1 / (1 + math.exp(-max(-30, min(30, z)))), 9)] += 1
    assert found == expected


def test_license_scan(spark):
    texts = ["Some text\nReleased under the MIT Licence.\nmore", "Copyright (c) 2020 A. Person\nReleased under the MIT License", "licensed under the apache licence version 2 0", "© 1999 X\n" + license_scan.KNOWN[-2][1].upper(), "Released under the MIT License. And more", None, "", "...", "x " * 40000]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS known", "2 AS license")
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert len(found) == 10
    assert (found[0]["license"], found[0]["notices"]) == (None, "MIT")
    assert found[1]["license"] == "MIT" and found[2]["license"] == "Apache-2.0" and found[3]["license"] == "ISC"
    assert found[4]["license"] is None and found[4]["n_notices"] == 0
    assert {found[n]["text_digest"] for n in (5, 6, 7)} == {license_scan.NOTHING} and found[5]["license"] is None


def test_licences_inside_texts(spark):
    mit, isc = license_scan.KNOWN[-3][1], license_scan.KNOWN[-2][1]
    texts = [f"Title\n\n{mit}\n\nThe end", f"{isc.upper()}\n \n{mit}", mit.split("\n\n")[0], f"Title\n\n{mit.replace('notice and', 'notice or')}"]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    found = sorted((r["notices"], r["n_notices"]) for r in license_scan.scan(docs).collect())
    assert found == [("", 0), ("", 0), ("ISC,MIT", 2), ("MIT", 1), ("MIT", 1)]
    digest = license_scan.known_digests(spark, [("A", "some words")])
    assert [r["license"] for r in license_scan.scan(spark.createDataFrame([(1, "Some words!")], "doc_id long, text string"), digest.unionByName(digest)).collect()] == ["A"]


def test_license_scan_is_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(1)
    lines = [text for _, text in license_scan.KNOWN]
    texts = ["\n".join(rng.choice([*lines, "plain text", "© 2001 me", ""]) for _ in range(9)) for _ in range(90)] + [None, ""]
    spark.createDataFrame([*enumerate(texts), *((None, t) for t in texts[:9]), *((3, t) for t in texts[:4])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, own.execute(license_scan.duckdb_sql()).fetchall())) == sorted(str(tuple(r)) for r in license_scan.scan(spark.read.parquet(str(tmp_path / "d"))).collect())


def test_language_id(spark):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "où", "être", "avec", "ça"]}
    rows = [(n, " ".join(rng.choices(vocabulary[lang], k=30)), lang, f"{lang}.example.{'de' if lang == 'de' else 'com'}") for n, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, "", None, "de.example.de"), (901, None, None, None), (902, "漢字" * 50, None, None), (903, "über", None, "de.example.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    found = {r["id"]: r for r in language_id.identify_documents(docs, model).collect()}
    assert all(found[r[0]]["language"] == r[2] and found[r[0]]["kept"] for r in rows[:180])
    assert found[900]["language"] == "de" and found[903]["language"] == "de"
    assert found[902]["language"] == "und" and not found[902]["kept"]
    assert len(found) == len(rows) and 902 not in {r["doc_id"] for r in language_id.keep_known(docs).collect()}
    pages = spark.createDataFrame([(1, "http://a.de/x", '<html lang="de"><body>und</body></html>'), (2, None, None), (3, "bad", "<p>the thing with other</p>")], "page_id long, url string, html string")
    both = {(r["kind"], r["id"]): r for r in language_id.identify(docs, pages, model).collect()}
    assert both["page", 1]["language"] == "de" and both["page", 3]["language"] == "en" and ("page", 2) in both


def test_repeated_rows_do_not_eat_the_sample(spark):
    rng = random.Random(12)
    rows = [(n, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20)), "en") for n in range(400)]
    many = [*rows, *[(None, "the same row again", "en")] * 400]
    schema = "doc_id long, text string, lang string"
    drawn = language_id.fit(spark.createDataFrame(rows, schema), rows=100).logs[0]
    again = language_id.fit(spark.createDataFrame(many, schema).repartition(3), rows=100).logs[0]
    assert np.count_nonzero(drawn > drawn.min()) > 300
    # The repeated row is one of the hundred at most: nearly all buckets have what they had.
    assert np.mean(np.abs(np.exp(drawn) - np.exp(again)) < 1e-4) > 0.99
    unlike = np.count_nonzero((drawn > drawn.min()) != (again > again.min()))
    assert unlike < 150  # one text of a hundred gave way to the repeated one


def test_fused_posterior_is_that_of_a_plain_program(spark):
    """Every posterior from the text likelihoods alone, by loops over rows."""
    rng = random.Random(7)
    vocabulary = {"en": ["the", "and", "thing"], "de": ["der", "und", "nicht"], "fr": ["le", "avec", "dans"]}
    hosts = ["a.site.de", "b.site.de", "www.x.com", "y.com", "news", None]
    rows = [(n, " ".join(rng.choices(vocabulary[lang], k=rng.randrange(0, 6))), lang, rng.choice(hosts)) for n, lang in enumerate(rng.choices(["en", "de", "fr"], k=150))]
    docs = spark.createDataFrame([*rows, rows[3], (None, None, None, "y.com")], "doc_id long, text string, lang string, source string")
    markup = [(n, rng.choice(["http://a.site.de/x", "https://y.com", "bad"]), f"<html lang='{rng.choice(['de', 'en', 'xx'])}'><p>{' '.join(rng.choices(vocabulary['de'], k=2))}</p>") for n in range(30)]
    pages = spark.createDataFrame(markup, "page_id long, url string, html string")
    model = language_id.fit(docs)
    evidence = language_id.document_evidence(docs).withColumn("kind", F.lit("document")).unionByName(language_id.html_evidence(pages).withColumn("kind", F.lit("page"))).collect()
    n, k = len(evidence), len(model.languages)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    logs = [model.likelihoods((e["text"] or "").encode()) for e in evidence]
    logs = [x - x.max() for x in logs]
    flat = np.log([(1 - language_id.UNKNOWN) / (k - 1)] * (k - 1) + [language_id.UNKNOWN])
    own = [softmax(x + flat) for x in logs]
    strength, corpus = language_id.STRENGTH, (sum(own) + language_id.STRENGTH / k) / (n + language_id.STRENGTH)
    domain = lambda h: ".".join(h.split(".")[-2:]) if "." in h else "-"
    rates = lambda chosen, groups: np.log((sum(own[i] for i in chosen) + 0.5) / (sum(own[i] for i in groups) + 0.5 * len({key[i] for i in groups})))
    expected = []
    for i, e in enumerate(evidence):
        host, fused = e["host"], logs[i].copy()
        prior = corpus
        if host is not None:
            near = [j for j in range(n) if j != i and evidence[j]["host"] is not None and domain(evidence[j]["host"]) == domain(host)]
            prior = (sum((own[j] for j in near), np.zeros(k)) + strength * corpus) / (len(near) + strength)
            same = [j for j in near if evidence[j]["host"] == host]
            prior = (sum((own[j] for j in same), np.zeros(k)) + strength * prior) / (len(same) + strength)
            if "." in host:
                key = {j: evidence[j]["host"].split(".")[-1] for j in range(n) if evidence[j]["host"] and "." in evidence[j]["host"]}
                fused += rates([j for j in key if key[j] == key[i]], list(key))
        fused += np.log(np.maximum(prior, 1e-6))
        if e["declared"]:
            key = {j: evidence[j]["declared"] for j in range(n) if evidence[j]["declared"]}
            fused += rates([j for j in key if key[j] == key[i]], list(key))
        posterior = softmax(fused)
        expected.append((e["kind"], e["id"], model.languages[int(posterior.argmax())], round(float(posterior.max()), 4)))
    found = [(r["kind"], r["id"], r["language"], round(r["posterior"], 4)) for r in language_id.identify(docs, pages, model).collect()]
    order = lambda r: repr(r)
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_empty_tables(spark, empty, tokenizer_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        exact_dedup.exact_dedup(empty), exact_dedup.drop_copies(empty), sharding.shard(empty), bpe.encode_digests(empty, tokenizer_path), near_dedup.near_duplicates(empty),
        suffix_dedup.repeated_spans(empty), license_scan.scan(empty), decontaminate.find_leaks(empty, bench), decontaminate.drop_leaks(empty, bench), quality.score(empty, quality.fit(empty, labels)),
        hmm.language_model_scores(empty, iterations=1), language_id.identify(empty, pages), language_id.keep_known(empty),
    ):
        assert made.count() == 0


def test_awkward_rows_come_through(docs, rows):
    assert quality.score(docs, quality.QualityModel(b"", b"", (0.0, 1.0, 1.0))).count() == len(rows)
    assert license_scan.scan(docs).count() >= len(rows)
    assert language_id.identify_documents(docs).count() == len(rows)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        exact_dedup.exact_dedup(spark.range(3).withColumnRenamed("id", "doc_id"))
