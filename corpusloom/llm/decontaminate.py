"""Benchmark decontamination: rare seeds of two words, then Smith-Waterman alignment.

A seed is a pair of words that follow one another in a test item; a document has it where the
two stand next to each other or with one word between. What still scores ``leak`` of an item's
own score cannot have lost many of its pairs: a word replaced or left out costs three points
and breaks two pairs, two words put in cost two points and break one, so a broken pair costs
one and a half points at least. An item's commonest pairs, by their number in the whole
corpus, can therefore be left out as seeds: so many rare ones are kept that any leak has
several of them within the longest stretch that it can fill. Every such stretch is aligned,
however common it is, so nothing that full alignment would report is missed.

Documents are never shuffled and are read twice for each block of the benchmark, once to count
and once to search. What the tasks get is the benchmark, in blocks of ``BLOCK_WORDS`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, require, text_or_empty

#: Scores of the alignment, and the part of an item's own score that makes a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.5
#: What a broken pair costs at least.
PAIR_COST = 1.5
#: Words of test items that go to the tasks at once.
BLOCK_WORDS = 500_000
#: Rows scanned at once in a task.
ROWS = 500

HITS = "doc_id long, item_id long, score double, start_word int, end_word int"
_HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of ``item`` in ``passage`` and the stretch of the passage that has it."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        ramp = -GAP * np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, dtype=np.int64)
        top, end = 0, 0
        for word in a:
            diagonal = row[:-1] + np.where(b == word, MATCH, MISMATCH)
            new = np.maximum(row + GAP, 0)
            np.maximum(new[1:], diagonal, out=new[1:])
            row = np.maximum.accumulate(new + ramp) - ramp
            at = int(row.argmax())
            if row[at] > top:
                top, end = int(row[at]), at
        return top, end

    if not len(item) or not len(passage):
        return 0, 0, 0
    score, end = best(item, passage)
    back = best(item[::-1], passage[:end][::-1])[1] if score else 0
    return score, end - back, end


def seeds_needed(n_words: int, leak: float) -> tuple[int, int]:
    """How many pairs of an item are seeds, and how many of them every leak has.

    (0, 0) for an item so short that a leak may have none of its pairs.
    """
    broken = int(MATCH * n_words * (1 - leak) / PAIR_COST + 1e-9)
    spare = n_words - 1 - broken
    least = (spare + 1) // 2
    return (broken + least, least) if spare > 0 else (0, 0)


@dataclass
class Benchmark:
    """Test items as word numbers, and their seeds."""

    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    leak: float
    #: Distinct pairs of all items, sorted.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: For each pair where its items begin in ``owners``; items have an entry for each of their seeds.
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: For each item the seeds that a leak has, and the most words that a leak fills.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: Items that must occur whole, by their words.
    whole: dict[tuple[int, ...], list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], leak: float = LEAK) -> Benchmark:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int64) for _, text in rows]
        made = cls([r[0] for r in rows], items, vocabulary, leak)
        long = [item for item in items if seeds_needed(len(item), leak)[0]]
        made.pairs = np.unique(np.concatenate([made.codes(item, 1) for item in long])) if long else made.pairs
        made.reach = np.array([len(item) + int(MATCH * len(item) * (1 - leak)) for item in items], dtype=np.int64)
        for n, item in enumerate(items):
            if len(item) and not seeds_needed(len(item), leak)[0]:
                made.whole.setdefault(tuple(item.tolist()), []).append(n)
        return made

    def codes(self, words: np.ndarray, distance: int) -> np.ndarray:
        """A number for each pair of words at a distance; -1 if one of them is in no item."""
        a, b = words[:-distance], words[distance:]
        return np.where((a >= 0) & (b >= 0), a * len(self.vocabulary) + b, -1)

    def seed(self, frequency: np.ndarray) -> None:
        """Choose the rarest pairs of each item as its seeds, by the frequency of each pair."""
        self.least = np.zeros(len(self.items), dtype=np.int64)
        chosen: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64)]
        for n, item in enumerate(self.items):
            kept, self.least[n] = seeds_needed(len(item), self.leak)
            if kept:
                own = np.searchsorted(self.pairs, self.codes(item, 1))
                own = own[np.lexsort((own, frequency[own]))][:kept]
                chosen.append(np.stack([own, np.full(kept, n)]))
        table = np.concatenate(chosen, axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.bounds = np.searchsorted(table[0], np.arange(len(self.pairs) + 1))
        self.owners = table[1]

    def pairs_in(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pair numbers) of the pairs of items in a sequence of word numbers."""
        for distance in (1, 2):
            if len(words) <= distance or not len(self.pairs):
                continue
            codes = self.codes(words, distance)
            at = np.flatnonzero(codes >= 0)
            own = codes[at]
            pair = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
            found = self.pairs[pair] == own
            yield at[found], pair[found]

    def counts_in(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.pairs), dtype=np.int64)
        for _, pair in self.pairs_in(words):
            out += np.bincount(pair, minlength=len(out))
        return out

    def stretches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, low, high): every stretch of some rows that can hold a leak of an item."""
        hits = [np.zeros((2, 0), dtype=np.int64)]
        for at, pair in self.pairs_in(words):
            n = self.bounds[pair + 1] - self.bounds[pair]
            which = np.repeat(self.bounds[pair], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits.append(np.stack([self.owners[which], np.repeat(at, n)]))
        item, at = np.concatenate(hits, axis=1)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        row = np.searchsorted(bounds, at, "right") - 1
        # The last of the seeds that a leak would have if it began with this one.
        last = np.arange(len(at)) + self.least[item] - 1
        inside = last < len(at)
        last = np.minimum(last, max(len(at) - 1, 0))
        dense = np.flatnonzero(inside & (item[last] == item) & (row[last] == row) & (at[last] - at <= self.reach[item]))
        low = np.maximum(bounds[row[dense]], at[dense] - self.reach[item[dense]])
        high = np.minimum(bounds[row[dense] + 1] - GAP_WORDS, at[dense] + self.reach[item[dense]] + 1)
        held: tuple[int, int, int, int] | None = None
        for r, i, a, b in zip(row[dense].tolist(), item[dense].tolist(), low.tolist(), high.tolist()):
            if held and held[:2] == (r, i) and a <= held[3]:
                held = (r, i, held[2], b)
            else:
                if held:
                    yield held
                held = (r, i, a, b)
        if held:
            yield held

    def whole_in(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same for items that must occur whole."""
        for own, which in self.whole.items():
            if len(words) < len(own):
                continue
            found = np.ones(len(words) - len(own) + 1, dtype=bool)
            for k, word in enumerate(own):
                found &= words[k : len(words) - len(own) + 1 + k] == word
            at = np.flatnonzero(found)
            rows, first = np.unique(np.searchsorted(bounds, at, "right") - 1, return_index=True)
            yield from ((r, n, a, a + len(own)) for r, a in zip(rows.tolist(), at[first].tolist()) for n in which)

    def leaks(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, start, end) of each item that leaked into each of some rows."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for row, item, low, high in [*self.stretches(words, bounds), *self.whole_in(words, bounds)]:
            own = self.items[item]
            if np.isin(words[low:high], own).sum() < self.leak * len(own):  # the score is at most MATCH for each of these
                continue
            score, start, end = smith_waterman(own, words[low:high])
            part = score / (MATCH * len(own))
            if part >= self.leak and part > best.get((row, item), (0.0, 0, 0))[0]:
                best[row, item] = (part, int(low + start - bounds[row]), int(low + end - bounds[row]))
        return [(*key, *found) for key, found in best.items()]


#: Gaps after each row, so that no pair reaches from one row into the next.
GAP_WORDS = 2


def _lots(batch: pa.RecordBatch, column: int, vocabulary: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of many rows with a gap after each, bounds of the rows)."""
    number = vocabulary.get
    for start in range(0, batch.num_rows, ROWS):
        numbers, bounds = [], [0]
        for text in batch.column(column).slice(start, ROWS).to_pylist():
            own = [number(w, -1) for w in words_of(text or "")]
            own += [-1] * GAP_WORDS
            numbers.append(np.array(own, dtype=np.int64))
            bounds.append(bounds[-1] + len(own))
        yield start, np.concatenate(numbers), np.array(bounds)


def _blocks(benchmark: DataFrame, leak: float) -> Iterator[Benchmark]:
    """The test items in blocks of a bounded size, one at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", text_or_empty().alias("text")).orderBy("item_id", "text").toLocalIterator():
        if rows and size + len(r["text"]) // 4 > BLOCK_WORDS:
            yield Benchmark.of(rows, leak)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4
    yield Benchmark.of(rows, leak)


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, leak: float) -> Iterator[Benchmark]:
    """Blocks of the benchmark whose seeds are the pairs that are rare in ``docs``."""
    require(docs, ["doc_id", "text"])
    require(benchmark, ["item_id", "text"])
    if not 0.25 < leak <= 1:
        raise ValueError("leak must be over 0.25 and at most 1")
    texts = docs.select(text_or_empty().alias("text"))
    for block in _blocks(benchmark, leak):

        def count(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(block.pairs), dtype=np.int64)
            for batch in batches:
                for _, words, _ in _lots(batch, 0, block.vocabulary):
                    total += block.counts_in(words)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

        frequency = np.zeros(len(block.pairs), dtype=np.int64)
        if len(block.pairs):  # the driver gets one number for each pair of the block
            for r in texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
                frequency[r["pair"]] = r["n"]
        block.seed(frequency)
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK) -> DataFrame:
    """One row per document and test item that leaked into it.

    Returns doc_id, item_id, score (1 for a whole copy) and the words of the document,
    from start_word up to end_word, that align; of equal scores in a document the first one.
    A null or empty text holds no leak and a test item without words leaks nowhere; an item
    of three words or fewer leaks where it stands whole; a null ``doc_id`` is reported as it is;
    repeated rows and items are each reported; an empty table gives an empty result. Texts are
    scanned whole, however long, and other columns are not read.
    """
    found = None
    for block in seeded_blocks(docs, benchmark, leak):

        def hits(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, words, bounds in _lots(batch, 1, block.vocabulary):
                    rows = [(batch.column(0)[start + row].as_py(), block.ids[item], part, a, b) for row, item, part, a, b in block.leaks(words, bounds)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HIT_SCHEMA)], schema=_HIT_SCHEMA)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(hits, HITS)
        # Of several blocks only the last is still held when the next is read.
        found = part if found is None else checkpoint(found).unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK) -> DataFrame:
    """``docs`` without the rows that hold a test item, columns unchanged.

    Each row is judged by its own text, so null or repeated ids and repeated rows make no
    difference; other cases as in ``find_leaks``.
    """
    require(docs, ["doc_id", "text"])
    at, kept = docs.columns.index("text"), None
    for block in seeded_blocks(docs, benchmark, leak):

        def clean(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for start, words, bounds in _lots(batch, at, block.vocabulary):
                    for row, *_ in block.leaks(words, bounds):
                        keep[start + row] = False
                yield batch.filter(pa.array(keep))

        kept = (docs if kept is None else checkpoint(kept)).mapInArrow(clean, docs.schema)
    return kept
