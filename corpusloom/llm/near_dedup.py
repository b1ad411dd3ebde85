"""Near-duplicate detection by Order MinHash.

The words of a text give k-mers of five words, each labelled with its number of occurrence.
A sketch picks the ``PICKED`` k-mers smallest by a hash and keeps them in text order; texts
that share a sketch are candidates. Because order counts, sharing one says more about edit
similarity than sharing a set of k-mers would. Candidates are verified by banded alignment of
their words: near duplicates have an edit distance of at most a fifth of the longer text.

Equal texts are one node from the start. In a bucket of texts that share a sketch, all are
aligned with the one of smallest id; what that leaves unlinked is compared further, see
``_remaining``. Links are merged into groups by spreading the smallest id, in rounds that are
checkpointed; nothing about single documents is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm.common import checkpoint, forget, join_hot, require, text_or_empty
from corpusloom.llm.decontaminate import words_of

#: Words in a k-mer, k-mers in a sketch, sketches of a text.
K = 5
PICKED = 2
SKETCHES = 16
#: Near duplicates agree in this part of the longer text.
SIMILARITY = 0.8

_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, SKETCHES, dtype=np.int64) | 1
_MULTIPLIERS = _MULTIPLIERS.astype(np.uint64)


def word_hashes(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """A 32-bit hash of each word."""
    out = []
    for word in words:
        own = cache.get(word)
        if own is None:
            own = cache[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")
        out.append(own)
    return np.array(out, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with their numbers of occurrence; a shorter text is one k-mer."""
    words = words.astype(np.uint64)
    size = max(1, min(K, len(words)))
    own = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for n in range(size if len(words) else 0):
        own = _mix(own * np.uint64(0x9E3779B97F4A7C15) + words[n : len(words) - size + 1 + n] + np.uint64(1))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.searchsorted(ranked, ranked, "left")
    label = np.empty(len(own), dtype=np.uint64)
    label[order] = (np.arange(len(own)) - first).astype(np.uint64)
    return _mix(own + label * np.uint64(0x9E3779B97F4A7C15))


def sketches(words: np.ndarray) -> list[int]:
    """The order min-hash sketches of a text; a text without words has none."""
    own = kmers(words)
    if not len(own):
        return []
    hashed = own[None, :] * _MULTIPLIERS[:, None]
    picked = min(PICKED, len(own))
    at, lines = np.empty((SKETCHES, picked), dtype=np.int64), np.arange(SKETCHES)
    for n in range(picked):
        at[:, n] = hashed.argmin(axis=1)
        hashed[lines, at[:, n]] = np.iinfo(np.uint64).max
    chosen = own[np.sort(at, axis=1)]
    value = np.zeros(SKETCHES, dtype=np.uint64)
    for n in range(picked):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + chosen[:, n] + np.uint64(n + 1))
    return value.view(np.int64).tolist()


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most ``most``, else ``most`` + 1.

    Bit-parallel alignment in the band of ``most`` diagonals either side of the main one: a
    column is one integer of 2 * most + 1 bits that slides down by one word a step.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    a, b = a[low:].tolist(), b[low:].tolist()
    while b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    if not b:
        return len(a)
    # Column t of the table belongs to b[t]; bit i of the window stands for a[t - most + i].
    width = 2 * most + 1
    mask = (1 << width) - 1
    places: dict[int, int] = {}
    for n, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << (n + most))
    # Vertical differences: above the first word the distance grows towards the top edge.
    plus, minus = mask & ~((1 << most) - 1), (1 << most) - 1
    minus, plus = minus & mask, plus & mask
    distance = most  # at the lower edge of the window before the first column
    for t, word in enumerate(b):
        equal = (places.get(word, 0) >> t) & mask
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        across_plus = (minus | ~(diagonal | plus)) & mask
        across_minus = plus & diagonal
        distance += 0 if diagonal >> (width - 1) & 1 else 1
        shifted = diagonal >> 1
        plus = (across_minus | ~(shifted | across_plus)) & mask
        minus = shifted & across_plus
    # ``distance`` is that of a[: len(b) + most] with b; walk up the last column to a's end.
    bit = width - 2
    for _step in range(len(b) + most - len(a)):
        distance -= (plus >> bit) & 1
        distance += (minus >> bit) & 1
        bit -= 1
    return min(distance, most + 1)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer text."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    words, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = np.minimum(np.bincount(counts[: len(a)], minlength=len(words)), np.bincount(counts[len(a) :], minlength=len(words))).sum()
    if longer - shared > most:  # each edit changes one word
        return False
    band = 8
    while band < most:  # near copies need a narrow band only
        if edit_distance(a, b, band) <= band:
            return True
        band *= 4
    return edit_distance(a, b, most) <= most


_SKETCHED = "key string, doc_id long, text_hash long, digest binary, n_words long, sketches array<long>"
_WORDS = "digest binary, words binary"
_PAIRS = "leader binary, member binary, linked boolean"


def _digest(words: list[str], text: str) -> bytes:
    """What equal texts share: their words, or the text itself if it has none."""
    return hashlib.blake2b("\x1f".join(words).encode() if words else b"\0" + text.encode(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        digests, lengths, all_sketches = [], [], []
        for text in batch.column(3).to_pylist():
            words = words_of(text)
            digests.append(_digest(words, text))
            lengths.append(len(words))
            all_sketches.append(sketches(word_hashes(words, cache)))
            if len(cache) > 500_000:
                cache.clear()
        arrays = [*(batch.column(n) for n in range(3)), pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array(all_sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "text_hash", "digest", "n_words", "sketches"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            words = words_of(text)
            rows.append((_digest(words, text), B.squeeze(word_hashes(words, cache).tobytes())))
            if len(cache) > 500_000:
                cache.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["digest", "words"])


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(np.frombuffer(B.unsqueeze(a), np.uint32), np.frombuffer(B.unsqueeze(b), np.uint32), similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["leader", "member", "linked"])

    return verify


def _aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(leader, member) pairs with whether they are near duplicates."""
    of_leader = words.select(F.col("digest").alias("leader"), F.col("words").alias("leader_words"))
    of_member = words.select(F.col("digest").alias("member"), F.col("words").alias("member_words"))
    both = pairs.join(of_member, "member").join(of_leader, "leader")
    return both.select("leader", "member", "leader_words", "member_words").mapInArrow(_verify(similarity), _PAIRS)


#: Texts, and words of texts, in a block of a bucket; a task compares one block with another.
BUCKET = 4096
BUCKET_WORDS = 4 << 20
#: Bins of the hashed word counts whose difference bounds the edit distance from below.
BINS = 64


def _bins(words: np.ndarray) -> np.ndarray:
    return np.bincount(words % BINS, minlength=BINS)


def _compare(similarity: float):
    def compare(table: pa.Table) -> pa.Table:
        """Links between the unlinked members of a bucket and all that came with them.

        Members that match the leader are one class from the start.
        """
        digests, packed, open_, matched = (table.column(c).to_pylist() for c in ("digest", "words", "open", "matched"))
        order = sorted(range(len(digests)), key=lambda n: (not open_[n], digests[n]))
        words = [np.frombuffer(B.unsqueeze(packed[n]), np.uint32) for n in order]
        lengths = np.array([len(w) for w in words])
        bins = np.array([_bins(w) for w in words]).reshape(len(words), BINS)
        root = list(range(len(words)))
        of_leader = [n for n in range(len(words)) if matched[order[n]]]
        for n in of_leader:
            root[n] = of_leader[0]

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        links = []
        for n in range(sum(open_)):
            longer = np.maximum(lengths[n + 1 :], lengths[n])
            difference = bins[n + 1 :] - bins[n]
            least = np.maximum(np.maximum(difference, 0).sum(axis=1), np.maximum(-difference, 0).sum(axis=1))
            for other in np.flatnonzero(least <= (1 - similarity) * longer + 1e-9) + n + 1:
                a, b = find(n), find(int(other))
                if a != b and similar(words[n], words[other], similarity):
                    root[b] = a
                    links.append((digests[order[n]], digests[order[other]]))
        columns = list(zip(*links)) or [(), ()]
        return pa.table({"leader": pa.array(columns[0], pa.binary()), "member": pa.array(columns[1], pa.binary())})

    return compare


def _remaining(members: DataFrame, checked: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links that the leaders of the buckets did not show.

    ``members`` has key, size, n_words of the text and of the bucket, leader and digest. What was
    not linked to its leader is compared with all of its bucket. A bucket of more than
    ``BUCKET`` texts or ``BUCKET_WORDS`` words is compared in blocks: each task has one block of
    the unlinked texts and one of the whole bucket.
    """
    unlinked = members.join(checked.where(~F.col("linked")).select("leader", F.col("member").alias("digest")), ["leader", "digest"]).select("key", "size", "bucket_words", "n_words", "digest")
    unlinked = checkpoint(unlinked)
    blocks = lambda n, words: F.ceil(F.greatest(F.col(n) / BUCKET, F.col(words) / BUCKET_WORDS)).cast("long")
    open_ = unlinked.groupBy("key").agg(F.first("size").alias("n"), F.first("bucket_words").alias("words"), F.count("*").alias("n_open"), F.sum("n_words").alias("words_open"))
    counts = checkpoint(open_.select("key", "n", blocks("n_open", "words_open").alias("lefts"), blocks("n", "words").alias("rights")))
    of_open = unlinked.select("key", "digest", F.lit(True).alias("open"))
    known = members.select("key", "digest").join(of_open, ["key", "digest"], "left").select("key", "digest", F.coalesce("open", F.lit(False)).alias("open"))
    dealt = checkpoint(join_hot(known, counts, "key", "n", F.hex("digest")).where("lefts IS NOT NULL"))
    hashed = F.xxhash64("digest", "key")
    task = lambda a, b: F.concat_ws(":", "key", a, b).alias("task")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    left = dealt.where("open").select("key", "digest", F.pmod(hashed, "lefts").alias("own"), each("rights")).select(task("own", "other"), "digest", F.lit(True).alias("open"), F.lit(False).alias("matched"))
    right = dealt.select("key", "digest", "open", F.pmod(hashed, "rights").alias("own"), each("lefts")).select(task("other", "own"), "digest", F.lit(False).alias("open"), (~F.col("open")).alias("matched"))
    sets = left.unionByName(right).groupBy("task", "digest").agg(F.max("open").alias("open"), F.min("matched").alias("matched"))
    return sets.join(words, "digest").groupBy("task").applyInArrow(_compare(similarity), "leader binary, member binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph (a, b): its component's smallest node.

    Large-star and small-star rounds until nothing changes, each checkpointed.
    """
    stars = checkpoint(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = checkpoint(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("x", "m")))
        large = join_hot(both, least, "x", "n", F.hex("y")).where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        joined = join_hot(large, low, "v", "n", F.hex("u"))
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        old, stars = stars, checkpoint(small)
        forget(old, least, large, low)
        now = tuple(stars.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``key``, which rows of one id and one text share, ahead of their columns."""
    text_hash = F.xxhash64(text_or_empty())
    return docs.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_hash).alias("key"), text_hash.alias("text_hash"), "*")


def _sketched(docs: DataFrame) -> DataFrame:
    """Digest and sketches of every row, with a number of its own; written down."""
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    return checkpoint(rows.select("key", "doc_id", "text_hash", "text").mapInArrow(_sketch, _SKETCHED).withColumn("row", F.monotonically_increasing_id()))


def _nodes(docs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The distinct texts (digest, n_rows, first) with the class of each (class_first, class_size).

    ``first`` is (no id, doc_id, text_hash) of a text's first row; a class has that of its first
    text. Written down.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "digest", "key"))
    texts = checkpoint(sketched.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n_rows"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches")))
    entries = texts.select("digest", "n_words", F.posexplode("sketches").alias("no", "value")).select("digest", "n_words", F.concat_ws(":", "no", "value").alias("key"))
    # Each bucket draws its own leader, so a text meets up to ``SKETCHES`` different ones.
    drawn = F.struct(F.xxhash64("digest", "key").alias("at"), "digest")
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_words").alias("bucket_words"), F.min(drawn).alias("leader")).where("size > 1")
    buckets = checkpoint(buckets.select("key", "size", "bucket_words", F.col("leader.digest").alias("leader")))
    members = checkpoint(join_hot(entries, buckets, "key", "size", F.hex("digest")).where("leader IS NOT NULL"))
    pairs = checkpoint(members.where("leader <> digest").select("leader", F.col("digest").alias("member")).distinct())
    involved = pairs.select(F.col("leader").alias("digest")).unionByName(pairs.select(F.col("member").alias("digest"))).distinct()
    wanted = involved.join(texts, "digest").select("first.key")
    rows = _keyed(docs.select("doc_id", text_or_empty().alias("text"))).select("key", "text")
    words = checkpoint(_one_of_each(rows, wanted, sketched, F.struct("text"), F.lit(0)).select("text").mapInArrow(_words, _WORDS).dropDuplicates(["digest"]))
    checked = checkpoint(_aligned(pairs, words, similarity))
    links = checkpoint(checked.where("linked").select("leader", "member").unionByName(_remaining(members, checked, words, similarity)))
    forget(buckets, members, pairs, words, checked)
    found = components(links.select(F.col("leader").alias("a"), F.col("member").alias("b")))
    nodes = checkpoint(texts.select("digest", "first", "n_rows").join(found, texts["digest"] == found["node"], "left").select("digest", "first", "n_rows", F.coalesce("root", "digest").alias("root")))
    classes = checkpoint(nodes.groupBy("root").agg(F.min("first").alias("class_first"), F.sum("n_rows").alias("class_size"), F.count("*").alias("n_texts")))
    out = checkpoint(join_hot(nodes, classes, "root", "n_texts", F.hex("digest")).select("digest", "n_rows", "first", "class_first", "class_size"))
    forget(texts, links, nodes, classes)
    return out


def _one_of_each(rows: DataFrame, wanted: DataFrame, counted: DataFrame, what: Column, order: Column) -> DataFrame:
    """``what`` (a struct) of one row of ``rows`` for each key of ``wanted``, the first by ``order``.

    ``counted`` has a row with ``key`` for each of ``rows``. Keys that many rows share are looked
    up by broadcast and merged in the tasks that read them, so no task gets them all.
    """
    counts = checkpoint(counted.groupBy("key").agg(F.count("*").alias("n")))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    own = wanted.select("key").distinct()
    if (most or 0) <= 1:
        return rows.join(own, "key", "left_semi").select(what.alias("own")).select("own.*")
    is_hot = (F.col("n") * 1000 > total) & (F.col("n") > 1)
    hot = counts.where(is_hot).select("key")
    few = F.broadcast(hot.join(own, "key", "left_semi"))
    rest = rows.join(F.broadcast(hot), "key", "left_anti")
    tied = own.join(counts.where((F.col("n") > 1) & ~is_hot), "key", "left_semi")
    single = own.join(counts.where("n > 1"), "key", "left_anti")
    many = rest.join(tied, "key", "left_semi").unionByName(rows.join(few, "key", "left_semi"))
    merged = many.groupBy("key").agg(F.min_by(what, order).alias("own")).select("own.*")
    return rest.join(single, "key", "left_semi").select(what.alias("own")).select("own.*").unionByName(merged)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size and kept of every row.

    Rows of a class are linked, directly or in a chain, by an edit distance of their words of
    at most ``1 - similarity`` of the longer text; ``class_id`` is the smallest ``doc_id`` of
    the class, which is the one that is kept, and ``class_size`` its number of rows. Words are
    compared without case and punctuation. A null text counts as empty; texts without any
    word are alike only if identical. A null ``doc_id`` goes last; of rows of one class with the
    same ``doc_id`` and different texts one is kept; rows that repeat ``doc_id`` and text are
    marked alike; texts are compared whole, however long; an empty table gives an empty result.
    Other columns are not read.
    """
    require(docs, ["doc_id", "text"])
    sketched = _sketched(docs)
    nodes = _nodes(docs, sketched, similarity)
    facts = nodes.select("digest", "n_rows", F.col("class_first.doc_id").alias("class_id"), F.col("class_first.key").alias("kept_key"), "class_size")
    out = join_hot(sketched.select("row", "key", "doc_id", "digest"), facts, "digest", "n_rows", F.col("row"))
    return out.select("doc_id", "class_id", "class_size", (F.col("key") == F.col("kept_key")).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with exactly one row of each class, columns unchanged.

    The row is the one that ``near_duplicates`` keeps; of rows that repeat ``doc_id`` and text (null
    ids too) the one whose columns come first as JSON. Other cases as in ``near_duplicates``.
    """
    require(docs, ["doc_id", "text"])
    sketched = _sketched(docs)
    wanted = _nodes(docs, sketched, similarity).select("class_first.key")
    rows = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))).select("key", "all")
    kept = _one_of_each(rows, wanted, sketched, F.col("all"), F.to_json("all"))
    return kept.to(docs.schema) if kept.schema != docs.schema else kept
