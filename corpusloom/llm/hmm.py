"""A hidden Markov language model trained by Baum-Welch.

Tokens are the words of a text, A-Z lower-cased, and one end. The hidden states emit word
*classes*: each of the ``TOP`` most frequent words is a class of its own, the others share
classes by their endings. A word's probability within its class comes from its count in the
whole training corpus, so the model has a probability for every text:

    P(text) = P(classes of its tokens by the HMM) * product of P(token | its class)

Counts of the unbounded vocabulary are answered block by block (``blocks``); a document is split
into words once, when its block is made. The parameters of the HMM have a fixed size and go to
every task. They start from the pairs of neighbouring classes of all training documents, counted
by a grouped sum over coarser classes: the driver fits the states to that table, whose size is
fixed. Each Baum-Welch iteration then runs over all training documents: tasks add up expected
counts, a grouped sum merges them, and the driver normalises, until the likelihood settles.
Long documents are cut into segments whose transfer matrices are multiplied, so the
recursions stay exact and still run over many segments at once.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm.common import checkpoint, forget, partitions, require, text_or_empty

#: Hidden states, word classes of their own, and shared classes.
STATES = 6
TOP = 2048
SHARED = 512
END = TOP + SHARED
CLASSES = END + 1
#: Baum-Welch iterations over all training documents at most; they end once one gains less than
#: ``SETTLED`` (natural logarithm, per token).
ITERATIONS = 40
SETTLED = 0.005
#: Coarse classes that the states are first fitted to: top words and endings; fits, and steps of each.
COARSE_TOP = 256
COARSE_SHARED = 128
COARSE = COARSE_TOP + COARSE_SHARED + 1
STARTS = 4
START_STEPS = 120
#: Tokens in a segment, and in what a task works on at once.
SEGMENT = 160
AT_ONCE = 400_000
#: Added to expected counts.
EMISSION_PRIOR = 0.01
TRANSITION_PRIOR = 1.0

CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary())])
_SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass
class Parameters:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # states by classes

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Parameters:
        initial = counts[:STATES] + TRANSITION_PRIOR
        transition = counts[STATES : STATES + STATES * STATES].reshape(STATES, STATES) + TRANSITION_PRIOR
        emission = counts[STATES + STATES * STATES :].reshape(STATES, CLASSES) + EMISSION_PRIOR
        return cls(initial / initial.sum(), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=1, keepdims=True))


N_CELLS = STATES + STATES * STATES + STATES * CLASSES
#: Sums rows of vectors over states by a product, which is much faster than a sum over a short axis.
_ONES = np.ones(STATES)


class Segments:
    """Some sequences of classes, cut into segments ordered from the longest to the shortest."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        self.sequences = sequences
        lengths = np.array([len(s) for s in sequences])
        per = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(sequences)), per)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        starts = (np.cumsum(lengths) - lengths)[owner] + number * SEGMENT
        sizes = np.minimum(SEGMENT, lengths[owner] - number * SEGMENT)
        order = np.argsort(-sizes, kind="stable")
        self.flat = np.concatenate(sequences).astype(np.int64)
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.bounds = np.concatenate([[0], np.cumsum(per)])
        self.starts, self.sizes, self.first = starts[order], sizes[order], (number == 0)[order]
        self.active = np.searchsorted(-self.sizes, -np.arange(SEGMENT), "left")
        # Only sequences of several segments need the matrices of these; most documents are one segment.
        self.of_several = np.flatnonzero((per > 1)[owner][order])

    def transfers(self, p: Parameters) -> np.ndarray:
        """The matrix (state before, state after, segment) that takes the forward vector through each segment of a longer sequence, up to a factor."""
        starts, sizes, first = (x[self.of_several] for x in (self.starts, self.sizes, self.first))
        active = np.searchsorted(-sizes, -np.arange(SEGMENT), "left")
        x = np.repeat(np.eye(STATES, dtype=p.transition.dtype)[:, :, None], len(starts), axis=2)
        onward = np.ascontiguousarray(p.transition.T)
        for t in range(SEGMENT):
            a = active[t]
            if not a:
                break
            step = np.matmul(onward, x[:, :, :a])
            if t == 0:
                step[:, :, first[:a]] = np.eye(STATES)[:, :, None]
            step *= p.emission.take(self.flat[starts[:a] + t], axis=1)
            if t % 2 or t == SEGMENT - 1:
                step /= step.sum(axis=(0, 1))
            x[:, :, :a] = step
        return x

    def likelihoods(self, p: Parameters) -> np.ndarray:
        """Natural log probability of each sequence, by the scaled forward recursion."""
        self._forward(p, self._through(p)[0], keep=False)
        return self.log

    def _through(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        """Forward vectors ahead of each segment, and backward vectors behind it, a column each."""
        n = len(self.starts)
        before, after = np.repeat(p.initial[:, None], n, axis=1), np.ones((STATES, n), dtype=p.initial.dtype)
        if not len(self.of_several):
            return before, after
        x = self.transfers(p)
        at_x = np.full(n, -1)
        at_x[self.of_several] = np.arange(len(self.of_several))
        per = np.diff(self.bounds)
        order = np.argsort(-per, kind="stable")[: int((per > 1).sum())]
        v = np.repeat(p.initial[:, None], len(per), axis=1)
        for k in range(per.max(initial=0)):
            live = order[: np.searchsorted(-per[order], -k, "left")]
            at = self.place[self.bounds[live] + k]
            before[:, at] = v[:, live]
            out = np.einsum("in,ijn->jn", v[:, live], x[:, :, at_x[at]])
            v[:, live] = out / out.sum(axis=0)
        w = np.ones((STATES, len(per)), dtype=p.initial.dtype)
        for k in range(per.max(initial=0) - 1, -1, -1):
            live = order[: np.searchsorted(-per[order], -k, "left")]
            at = self.place[self.bounds[live] + k]
            after[:, at] = w[:, live]
            back = np.einsum("ijn,jn->in", x[:, :, at_x[at]], w[:, live])
            w[:, live] = back / back.sum(axis=0)
        return before, after

    def _forward(self, p: Parameters, before: np.ndarray, keep: bool) -> list[np.ndarray]:
        """Scaled forward vectors by place in the segments, if they are kept; ``log`` gets the log probabilities of the sequences."""
        alphas, alpha, scale = [], before, np.zeros(len(self.starts))
        product, held = np.ones(len(self.starts)), 0
        onward = np.ascontiguousarray(p.transition.T)
        for t in range(SEGMENT):
            a = self.active[t]
            if not a:
                break
            moved = onward @ alpha[:, :a]
            if t == 0:
                moved[:, self.first[:a]] = alpha[:, :a][:, self.first[:a]]
            moved *= p.emission.take(self.flat[self.starts[:a] + t], axis=1)
            total = moved.sum(axis=0)
            moved /= total
            alpha = moved
            product[:a] *= total
            held += 1
            if held == 16:  # sixteen factors of at least 1e-12 or so stay above the least double
                scale += np.log(product)
                product[:], held = 1.0, 0
            if keep:
                alphas.append(alpha)
        by_segment = scale + np.log(product)
        self.log = np.add.reduceat(by_segment[self.place], self.bounds[:-1]) if len(self.bounds) > 1 else np.zeros(0)
        return alphas

    def expected(self, p: Parameters) -> np.ndarray:
        """Expected counts of starts, transitions and emissions over all sequences; ``log`` gets their log probabilities."""
        # Single precision is enough for counts, which are summed in double, and takes half the time; scores are exact.
        p = Parameters(*(x.astype(np.float32) for x in (p.initial, p.transition, p.emission)))
        before, after = self._through(p)
        alphas = self._forward(p, before, keep=True)
        starts, moves, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        onward = np.ascontiguousarray(p.transition.T)
        beta = after
        for t in range(len(alphas) - 1, -1, -1):
            a = self.active[t]
            ahead = beta[:, :a]
            gamma = alphas[t] * ahead
            gamma /= gamma.sum(axis=0)
            weighted = p.emission.take(self.flat[self.starts[:a] + t], axis=1)
            weighted *= ahead
            if t:
                source, target = alphas[t - 1][:, :a], weighted
            else:
                starts += gamma[:, self.first[:a]].sum(axis=1)
                inner = ~self.first[:a]
                source, target = before[:, :a][:, inner], weighted[:, inner]
            norm = ((onward @ source) * target).sum(axis=0)
            moves += p.transition * (source @ (target / norm).T)
            back = p.transition @ weighted
            back /= back.sum(axis=0)
            beta[:, :a] = back
            alphas[t] = gamma  # its classes are counted below, all places at once
        classes = self.flat[np.concatenate([self.starts[: self.active[t]] + t for t in range(len(alphas))])]
        for state in range(STATES):
            emitted[state] = np.bincount(classes, np.concatenate([g[state] for g in alphas]), CLASSES)
        return np.concatenate([starts, moves.ravel(), emitted.ravel()])


def shared_class(word: bytes) -> int:
    """The class by ending that a word has unless it has one of its own."""
    return TOP + zlib.crc32(word[-3:]) % SHARED


@dataclass
class Block:
    """Documents as numbers of the distinct words of their block."""

    ids: list[int | None]
    held_out: list[bool]
    lengths: np.ndarray
    flat: np.ndarray
    words: list[bytes]
    #: For each word the bucket that answers for it.
    buckets: np.ndarray

    def train_counts(self) -> np.ndarray:
        learnt = np.repeat(~np.array(self.held_out, dtype=bool), self.lengths)
        return np.bincount(self.flat[learnt], minlength=len(self.words))


def _maker(n: int):
    def make(batches: list[pa.RecordBatch]) -> bytes:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids, held_out, parts = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held_out += batch.column(1).to_pylist()
            for text in batch.column(2):
                words = text.as_buffer().to_pybytes().lower().split()
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        buckets = np.fromiter((zlib.crc32(w) % n for w in number), np.int32, len(number))
        flat = np.concatenate(parts)
        # Words are numbered as they come, so common ones have small numbers, and the high halves compress to little.
        halves = (flat & 0xFFFF).astype(np.uint16), (flat >> 16).astype(np.uint16)
        block = (ids, held_out, np.array([len(x) for x in parts]), *halves, b"\n".join(number), buckets)
        return B.squeeze(pickle.dumps(block, protocol=5))

    return make


def _read(payload) -> Block:
    ids, held_out, lengths, low, high, words, buckets = pickle.loads(B.unsqueeze(memoryview(payload)))
    return Block(ids, held_out, lengths, low | high.astype(np.int32) << 16, words.split(b"\n") if len(buckets) else [], buckets)


def _questions(block: Block, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    counts = block.train_counts()
    for bucket in np.unique(block.buckets).tolist():
        own = np.flatnonzero(block.buckets == bucket)
        yield bucket, b"\n".join([block.words[k] for k in own]), counts[own].astype(np.uint64).tobytes()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over the corpus for all that was asked; summaries go under negative block numbers."""
    totals: dict[bytes, int] = {}
    questions: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for block, bucket, asked, given in zip(*[c.to_pylist() for c in batch.columns]):
            for word, n in zip(B.unsqueeze(asked).split(b"\n"), np.frombuffer(B.unsqueeze(given), dtype=np.uint64).tolist()):
                totals[word] = totals.get(word, 0) + n
            questions.append((block, bucket, asked))
    if not questions:
        return

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), B.ANSWER_SCHEMA)], schema=B.ANSWER_SCHEMA)

    by_class = np.zeros((2, SHARED), dtype=np.int64)
    for word, n in totals.items():
        if n:
            by_class[:, shared_class(word) - TOP] += (n, 1)
    top = heapq.nsmallest(TOP, ((-n, w) for w, n in totals.items() if n))
    task = TaskContext.get().partitionId()
    yield batch_of([(-1, task, by_class.tobytes()), (-2, task, b"\n".join(b"%d %s" % (-n, w) for n, w in top))])
    for block, bucket, asked in questions:
        answer = np.array([totals[w] for w in B.unsqueeze(asked).split(b"\n")], dtype=np.uint64)
        yield batch_of([(block, bucket, B.squeeze(answer.tobytes()))])


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            counts = np.frombuffer(blob, dtype=np.int64).reshape(2, SHARED)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(counts[0]), pa.array(counts[1])], names=["shared", "n", "v"])


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pairs = [x.split(b" ", 1) for x in blob.split(b"\n") if x]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(pairs), pa.int32()), pa.array([p[1] for p in pairs], pa.binary()), pa.array([int(p[0]) for p in pairs], pa.int64())], names=["task", "word", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows of the corpus: fixed in size."""

    top: dict[bytes, int]
    top_counts: np.ndarray
    shared_tokens: np.ndarray
    shared_words: np.ndarray
    documents: int
    tokens: int
    words: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _coder(vocabulary: Vocabulary):
    def code_block(block: Block, answers: list[tuple[int, bytes]]) -> pa.Table:
        seen = np.zeros(len(block.words))
        for bucket, answer in answers:
            seen[block.buckets == bucket] = np.frombuffer(answer, dtype=np.uint64)
        classes = np.fromiter((c if (c := vocabulary.top.get(w)) is not None else shared_class(w) for w in block.words), np.int64, len(block.words))
        shared = np.maximum(classes - TOP, 0)
        within = np.where(classes < TOP, 0.0, np.log10((seen + 0.5) / (vocabulary.shared_tokens[shared] + 0.5 * (vocabulary.shared_words[shared] + 1))))
        base, end = vocabulary.base(seen), float(vocabulary.base(np.array([vocabulary.documents]))[0])
        narrow, rows, start = classes.astype(np.uint16), [], 0
        for doc_id, held_out, n in zip(block.ids, block.held_out, block.lengths.tolist()):
            at = block.flat[start : start + n]
            start += n
            known = int((seen[at] > 0).sum()) + (vocabulary.documents > 0)
            rows.append((doc_id, held_out, n + 1, known, float(base[at].sum()) + end, float(within[at].sum()), B.squeeze(np.append(narrow[at], np.uint16(END)).tobytes())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CODED_SCHEMA)], schema=_CODED_SCHEMA)

    return code_block


def _lots(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows and the class sequences in one of their columns, some hundred thousand tokens at a time."""
    rows, sequences, size = [], [], 0
    for batch in batches:
        first = 0
        for n, packed in enumerate(batch.column(at), 1):
            own = np.frombuffer(B.unsqueeze(packed.as_buffer()), dtype=np.uint16)
            sequences.append(own)
            size += len(own)
            if size >= AT_ONCE:
                yield [*rows, batch.slice(first, n - first)], sequences
                rows, sequences, size, first = [], [], 0, n
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if rows:
        yield rows, sequences


def _learnt(rows: DataFrame) -> DataFrame:
    """The class sequences of the training documents."""
    return rows.where(~F.col("held_out")).select("classes")


def _pairs(coarse: np.ndarray):
    """Counts of pairs of neighbouring coarse classes in training documents."""

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COARSE * COARSE, dtype=np.int64)
        for _, sequences in _lots(batches, 0):
            flat = coarse[np.concatenate(sequences)]
            inner = np.ones(len(flat), dtype=bool)
            inner[np.cumsum([len(x) for x in sequences]) - 1] = False  # an end has no successor
            inner = np.flatnonzero(inner)
            total += np.bincount(flat[inner] * COARSE + flat[inner + 1], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    return count_pairs


def _expect(p: Parameters):
    """Expected counts by cell; after the last the log probability, and the number of tokens."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CELLS + 2)
        for _, sequences in _lots(batches, 0):
            segments = Segments(sequences)
            total[:N_CELLS] += segments.expected(p)
            total[N_CELLS:] += (segments.log.sum(), len(segments.flat))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "value"])

    return expect


def _scorer(p: Parameters, tokens: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sequences in _lots(batches, 6):
            logs = Segments(sequences).likelihoods(p) / np.log(10)
            whole = pa.Table.from_batches(rows).combine_chunks()
            column = lambda name: whole.column(name).combine_chunks()
            scores = logs + column("within").to_numpy()
            known = [column(name) for name in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(np.full(len(logs), tokens)), column("base_score"), pa.array(scores)], schema=_SCORE_SCHEMA)

    return score


def coded(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Every document as classes with its base score, and the vocabulary; written once, read often."""
    require(docs, ["doc_id", "text"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty().cast("binary").alias("text"))
    documents = rows.where(~F.col("held_out")).count()
    n = partitions(docs.sparkSession)
    blocks = checkpoint(B.pack(rows, make=_maker(n)))  # read for the questions and for their answers
    answers = checkpoint(B.ask(blocks, _questions, _read).mapInArrow(_totals, B.ANSWERS))
    shared = {r["shared"]: (r["n"], r["v"]) for r in answers.where("block = -1").mapInArrow(_class_rows, "shared long, n long, v long").groupBy("shared").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    # The top words of the tasks are merged in two steps, of as many lists each; the driver gets TOP rows.
    lists = answers.where("block = -2").mapInArrow(_top_rows, "task int, word binary, n long").withColumn("part", F.pmod("task", F.lit(max(1, math.isqrt(n)))))
    best = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "word"))
    top = lists.withColumn("place", best).where(F.col("place") <= TOP).select("word", "n").orderBy(F.desc("n"), "word").limit(TOP)
    top = checkpoint(top).collect()
    by_class = np.array([shared.get(k, (0, 0)) for k in range(SHARED)], dtype=np.float64)
    tokens, words = int(by_class[:, 0].sum()) + documents, int(by_class[:, 1].sum()) + (documents > 0)
    for row in top:
        by_class[shared_class(bytes(row["word"])) - TOP] -= (row["n"], 1)
    vocabulary = Vocabulary({bytes(r["word"]): n for n, r in enumerate(top)}, np.array([r["n"] for r in top], dtype=np.float64), by_class[:, 0], by_class[:, 1], documents, tokens, words)
    out = checkpoint(B.resolve(blocks, answers.where("block >= 0"), _coder(vocabulary), CODED, read=_read))
    forget(blocks, answers)
    return out, vocabulary


def _coarse(vocabulary: Vocabulary) -> np.ndarray:
    """The coarse class of each class."""
    out = np.empty(CLASSES, dtype=np.int64)
    out[TOP:END] = COARSE_TOP + np.arange(SHARED) % COARSE_SHARED
    out[:TOP] = np.minimum(np.arange(TOP), COARSE_TOP - 1)
    for word, n in vocabulary.top.items():
        if n >= COARSE_TOP:
            out[n] = out[shared_class(word)]
    out[END] = COARSE - 1
    return out


def fit_pairs(pairs: np.ndarray, seed: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """States fitted to a table of pairs of neighbours: log likelihood, their shares, transitions and emissions."""
    rng = np.random.default_rng(seed)
    share, transition = np.full(STATES, 1 / STATES), rng.random((STATES, STATES)) + 0.5
    emission = (pairs.sum(axis=0) + pairs.sum(axis=1) + 0.1) * rng.gamma(1.0, 1.0, (STATES, len(pairs)))
    transition /= transition.sum(axis=1, keepdims=True)
    emission /= emission.sum(axis=1, keepdims=True)
    log = 0.0
    for _ in range(START_STEPS):
        first = share[:, None] * emission
        second = transition @ emission
        chance = np.maximum(first.T @ second, 1e-300)
        ratio = pairs / chance
        log = float((pairs * np.log(chance)).sum())
        moves = transition * (first @ ratio @ emission.T) + 0.1
        of_first = first * (second @ ratio.T)
        of_second = emission * ((first.T @ transition).T @ ratio)
        share = of_first.sum(axis=1) + 0.1
        emission = of_first + of_second + 1e-3
        share, transition, emission = share / share.sum(), moves / moves.sum(axis=1, keepdims=True), emission / emission.sum(axis=1, keepdims=True)
    return log, share, transition, emission


def start(rows: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Where the iterations begin: states fitted to the pairs of classes of all training documents."""
    weights = np.zeros(CLASSES)
    weights[: len(vocabulary.top_counts)] = vocabulary.top_counts
    weights[TOP:END] = vocabulary.shared_tokens
    weights[END] = vocabulary.documents
    weights += EMISSION_PRIOR
    coarse = _coarse(vocabulary)
    pairs = np.zeros(COARSE * COARSE)
    found = _learnt(rows).mapInArrow(_pairs(coarse), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    fits = [fit_pairs(pairs.reshape(COARSE, COARSE), seed) for seed in range(STARTS)]
    _, share, transition, emission = max(fits, key=lambda fit: fit[0])
    fine = emission[:, coarse] * weights / np.bincount(coarse, weights, COARSE)[coarse]
    return Parameters(share, transition, fine / fine.sum(axis=1, keepdims=True))


def p_total(counts: np.ndarray) -> float:
    """The number of tokens behind some expected counts."""
    return float(counts[STATES + STATES * STATES :].sum())


def train(rows: DataFrame, vocabulary: Vocabulary, iterations: int = ITERATIONS, settled: float = SETTLED) -> Parameters:
    """Baum-Welch over all training documents until the likelihood settles, at most some iterations."""
    p, before = start(rows, vocabulary), None
    for _ in range(iterations):
        sums = _learnt(rows).mapInArrow(_expect(p), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        counts = np.zeros(N_CELLS + 2)
        counts[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
        p = Parameters.from_counts(counts[:N_CELLS])
        now = counts[N_CELLS] / max(counts[N_CELLS + 1], 1.0)
        if before is not None and now - before < settled:
            break
        before = now
    return p


def language_model_scores(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Train on the rows whose crc32(doc_id as text) mod 5 is not 1 and score every row.

    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (the smoothed unigram model) and score (the HMM), both log10 probabilities of
    the whole text, however long. A null text counts as empty and has one token, its end; a row
    with a null ``doc_id`` is trained on; repeated rows count each time; an empty table gives an
    empty result, and with no training rows the model is flat. Other columns are not read.
    """
    rows, vocabulary = coded(docs)
    return rows.mapInArrow(_scorer(train(rows, vocabulary, iterations), vocabulary.tokens), SCORES)
