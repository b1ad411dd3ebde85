"""Quality by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled
bad. A document is compressed with each, in pieces so short that the dictionary and not the
document's own repetitions decides, and without any. The difference of the sizes with the two
dictionaries, normalised once by the size without a dictionary and once by the length, is the
evidence. A logistic curve fitted on labelled rows kept out of the dictionaries turns it into
a probability. Only the text is ever an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, require, text_or_empty

#: The bound on what is learnt from: rows of each label, and bytes of text of each label.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 12 << 20
#: Size of a dictionary, length of the pieces it is trained on, and the compression level.
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 2048
LEVEL = 3
#: Bytes of a document compressed at once, and what is added to its length, so that the frame
#: of a short text weighs little.
BLOCK_BYTES = 512
SHORT = 64

SCORES = "doc_id long, held_out boolean, score double, predicted int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def score(self, evidence: tuple[float, ...]) -> float:
        """Probability of the label 1."""
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


class Sizes:
    """Compressed sizes of a text: without a dictionary, with the good one and with the bad one."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)]
        for data in (good, bad):
            if data:
                own = zstandard.ZstdCompressionDict(data)
                own.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
            else:
                self.compressors.append(self.compressors[0])

    def evidence(self, text: bytes) -> tuple[float, ...]:
        """The difference between the dictionaries, by the size without one and by the length."""
        blocks = [text[n : n + BLOCK_BYTES] for n in range(0, len(text), BLOCK_BYTES)] or [b""]
        plain, good, bad = (sum(len(c.compress(block)) for block in blocks) for c in self.compressors)
        return (bad - good) / plain, (bad - good) / (len(text) + SHORT)


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[n : n + PIECE_BYTES] for t in texts for n in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 4)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes of weighted rows by Newton's method, lightly regularised."""
    if not len(x):
        return (0.0, 0.0, 0.0)
    features = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (p - y)) + 1e-3 * w
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(doc_id: Column | str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text, modulo ``folds``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    Per label the ``rows`` ids smallest by hash are drawn, then as many whole texts as fit
    ``n_bytes``; half of each make the dictionary, half the calibration, whose rows are weighted so that
    the labels have their shares of all learnable rows. Rows without a label or with
    conflicting labels teach nothing.
    """
    require(docs, ["doc_id", "text"])
    require(labels, ["doc_id", "quality"])
    sure = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    by_label = [sure.where(F.col("low") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for label in (0, 1)]
    drawn = checkpoint(by_label[0].unionByName(by_label[1]).select("doc_id", F.col("low").alias("label")))
    # At most ``rows`` ids a label are broadcast. Of rows that repeat an id the least text is taken.
    texts = checkpoint(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = texts.select("doc_id", "label", F.sum(F.octet_length("text")).over(order).alias("used")).where(F.col("used") <= n_bytes).select("doc_id", "label")
    collected = texts.join(F.broadcast(chosen), ["doc_id", "label"], "left_semi").collect()
    parts: dict[tuple[int, int], list[bytes]] = {(label, half): [] for label in (0, 1) for half in (0, 1)}
    for n, r in enumerate(sorted(collected)):
        parts[r["label"], n % 2].append(r["text"].encode())
    good, bad = _dictionary(parts[1, 0]), _dictionary(parts[0, 0])
    sizes = Sizes(good, bad)
    x = np.array([sizes.evidence(t) for label in (0, 1) for t in parts[label, 1]])
    y = np.array([float(label) for label in (0, 1) for t in parts[label, 1]])
    known = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    counts = {r["low"]: r["count"] for r in sure.where(F.col("low").isin(0, 1)).join(known, "doc_id", "left_semi").groupBy("low").count().collect()}
    share = {label: counts.get(label, 0) / max(1, sum(counts.values())) for label in (0, 1)}
    weight = np.array([share[label] * len(y) / len(parts[label, 1]) for label in (0, 1) for t in parts[label, 1]])
    return QualityModel(good, bad, _logistic(x, y, weight))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted for every row.

    The whole text is compressed, whatever its length. A null text counts as empty and an
    empty text is scored by what its frames cost, as any other; rows with a null ``doc_id``
    are scored and not held out; repeated rows are scored alike; an empty table gives an
    empty result. Other columns are not read.
    """
    require(docs, ["doc_id", "text"])

    def score_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None
        for batch in batches:
            sizes = sizes or Sizes(model.good, model.bad)
            scores = [model.score(sizes.evidence(t.as_buffer().to_pybytes())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), held_out().alias("held_out")).mapInArrow(score_task, SCORES)
