"""Cosine search: the exact scan, and an index of cells that is probed and then completed exactly.

Both score a batch of points against a block of questions as one matrix product in Arrow
batches, and keep the best of each question while a task runs: a task sends on ``k`` rows a
question, whatever its number of points. Points are never shuffled by a search.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Questions that go to the tasks at once; more are taken in blocks.
QUESTIONS_AT_ONCE = 10_000
#: Scores made at once in a task.
SCORES_AT_ONCE = 1 << 22
#: Below so many points a scan is cheaper than an index.
FULL_SCAN = 10_000
#: The sample that cells are trained on, the steps of training, and the most cells.
SAMPLE, STEPS, MOST_CELLS = 65_536, 12, 4096
#: Points of a cell in one file; a cell with more has several, so that none is one task's.
FILE_POINTS = 250_000
#: The part of the best that the probes should find, and the points of the sample that say how many that takes.
RECALL, JUDGES = 0.95, 256
#: What a rounded score may differ from the exact one.
SLACK = 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; a null or zero vector is a row of NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = column.is_valid().to_numpy(zero_copy_only=False)
    kept = column.filter(pa.array(good)) if not good.all() else column
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(len(kept), 1)
    if width * len(kept) != len(flat):
        raise ValueError("vectors of different lengths")
    out = np.full((len(column), width), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        rows = flat.reshape(len(kept), width)
        out[good] = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return out


@dataclass(frozen=True)
class Block:
    """Questions in a task: their ids, rows of a matrix, and what scope and book each may see."""

    ids: list
    rows: np.ndarray
    scope: list | None
    book: list | None


class Best:
    """The ``k`` best points of each question so far: by score rounded to six places, then by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple[float, object]]] = [[] for _ in range(n)]

    def add(self, numbers: np.ndarray, ids: list, scores: np.ndarray) -> None:
        """Scores of points (rows) for some questions (columns, by number); a point of score -inf is not seen."""
        for column, number in enumerate(numbers):
            own, held = scores[:, column], self.rows[number]
            least = -held[-1][0] if len(held) == self.k else -np.inf
            if len(own) > self.k:
                least = max(least, np.partition(own, len(own) - self.k)[len(own) - self.k])
            near = np.flatnonzero((own >= least) & (own > -np.inf))
            if len(near):
                self.rows[number] = heapq.nsmallest(self.k, [*held, *((-float(own[n]), ids[n]) for n in near)])


def _scored(block: Block, numbers: np.ndarray, ids: list, points: np.ndarray, scopes: list | None, books: list | None, best: Best) -> None:
    """The scores of points for the questions of some numbers, a bounded number at once."""
    if not len(numbers):
        return
    most = max(1, SCORES_AT_ONCE // len(numbers))
    for low in range(0, len(ids), most):
        part = slice(low, low + most)
        scores = np.round(points[part] @ block.rows[numbers].T, 6)
        scores[np.isnan(scores)] = -np.inf
        if scopes is not None and block.scope is not None:
            scores[np.array([[a != b or a is None for b in (block.scope[n] for n in numbers)] for a in scopes[part]]).reshape(scores.shape)] = -np.inf
        if books is not None and block.book is not None:
            scores[np.array([[b is not None and a != b for b in (block.book[n] for n in numbers)] for a in books[part]]).reshape(scores.shape)] = -np.inf
        best.add(numbers, ids[part], scores)


def blocks(questions: DataFrame, scope: str | None, book: str | None) -> Iterator[Block]:
    """The questions, a stated set, in blocks of at most about ``QUESTIONS_AT_ONCE``."""
    columns = [c for c in (scope, book) if c]
    n = questions.count()
    parts = max(1, -(-n // QUESTIONS_AT_ONCE))
    for part in range(parts):
        own = questions if parts == 1 else questions.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        table = own.select("q", "vector", *columns).toArrow()
        yield Block(table.column("q").to_pylist(), matrix(table.column("vector")) if len(table) else np.zeros((0, 0)), table.column(scope).to_pylist() if scope else None, table.column(book).to_pylist() if book else None)


def _searched(points: DataFrame, block: Block, k: int, scope: str | None, book: str | None, chosen: Callable[[dict], list[tuple[np.ndarray, np.ndarray]]], q_type, more: tuple[str, ...] = ()) -> DataFrame:
    """(q, id, score) of the ``k`` best points in every task; ``chosen`` pairs rows of a batch with questions."""
    sent = points.sparkSession.sparkContext.broadcast(block)
    id_type = points.schema["id"].dataType
    columns = ["id", "vector", *[c for c in (scope, book) if c], *more]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best, kinds = Best(len(own.ids), k), None
        for batch in batches:
            kinds = kinds or batch.schema.field("id").type
            held = {name: batch.column(batch.schema.get_field_index(name)) for name in columns}
            rows = matrix(held["vector"])
            ids = held["id"].to_pylist()
            scopes = held[scope].to_pylist() if scope else None
            books = held[book].to_pylist() if book else None
            for places, numbers in chosen(held, own):
                pick = lambda values: None if values is None else [values[n] for n in places]
                _scored(own, numbers, pick(ids), rows[places], pick(scopes), pick(books), best)
        found = [(own.ids[n], i, -s) for n, rows_ in enumerate(best.rows) for s, i in rows_]
        if found:
            qs, found_ids, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(found_ids, kinds), pa.array(scores, pa.float64())], names=["q", "id", "score"])

    return points.select(*columns).mapInArrow(search, f"q {q_type.simpleString()}, id {id_type.simpleString()}, score double")


def _everything(held: dict, block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.arange(len(held["id"])), np.arange(len(block.ids)))]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id")))).where(F.col("rank") <= k)


def nearest(questions: DataFrame, points: DataFrame, k: int = 20, scope: str | None = None, book: str | None = None) -> DataFrame:
    """(q, id, score, rank): the ``k`` points nearest to each question by cosine, by a scan of all points.

    ``questions`` has q and vector, ``points`` id and vector. With ``scope`` both have that column
    and a question sees its own scope alone; with ``book`` it sees one book alone where its own
    column of that name is not null. Points or questions without a vector, or with one of zeros, match nothing.
    """
    out = None
    for block in blocks(questions, scope, book):
        found = _searched(points, block, k, scope, book, _everything, questions.schema["q"].dataType)
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k)


# The cell index ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class CellIndex:
    """Cells of unit vectors: their centres, the least cosine of a point to its centre, and their sizes.

    The points lie in ``path``/points, a folder a cell; ``cells`` is as large as the number of cells.
    ``probes`` is how many cells hold ``RECALL`` of the twenty best, by the sample the cells were trained on.
    """

    spark: SparkSession
    path: str
    centres: np.ndarray
    least: np.ndarray
    sizes: np.ndarray
    probes: int
    id_type: str

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def order(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each question the cosines of the centres, and the most that a point of each cell can reach."""
        near = np.clip(np.nan_to_num(rows @ self.centres.T, nan=-1.0), -1, 1)
        apart = np.arccos(near) - np.arccos(np.clip(self.least, -1, 1))[None, :]
        return near, np.where(self.sizes[None, :] > 0, np.cos(np.clip(apart, 0, np.pi)), -np.inf)


def trained(sample: np.ndarray, n_cells: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Centres by spherical k-means; an empty cell takes the point that is worst served."""
    rng = np.random.default_rng(seed)
    rows = sample[~np.isnan(sample).any(axis=1)]
    n_cells = max(1, min(n_cells, len(rows)))
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    centres = rows[rng.choice(len(rows), n_cells, replace=False)]
    for _ in range(steps):
        near = rows @ centres.T
        own, served = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=n_cells) == 0)
        sums[empty] = rows[np.argsort(served, kind="stable")[: len(empty)]]
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int = 20, wanted: float = RECALL) -> int:
    """How many of the nearest cells hold that part of the ``k`` nearest of some points of the sample.

    In the corpus, which is denser than its sample, the nearest are nearer and need fewer.
    """
    rows = sample[~np.isnan(sample).any(axis=1)]
    if not len(rows):
        return 1
    cell = (rows @ centres.T).argmax(axis=1)
    asked = rows[:: max(1, len(rows) // JUDGES)]
    places = np.empty((len(asked), min(k, len(rows))), dtype=np.int64)
    for n, row in enumerate(asked):
        best = np.argpartition(-(rows @ row), places.shape[1] - 1)[: places.shape[1]]
        order = np.empty(len(centres), dtype=np.int64)
        order[np.argsort(-(centres @ row), kind="stable")] = np.arange(len(centres))
        places[n] = order[cell[best]]
    return int(np.sort(places.ravel())[min(places.size - 1, int(np.ceil(wanted * places.size)) - 1)]) + 1


def build(points: DataFrame, path: str, n_cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> CellIndex:
    """The index of ``points`` (id, vector, and any scopes) at ``path``.

    Cells are trained on the ``sample`` rows smallest by a hash of their id, the one bounded step; every
    row is then put into the cell of its nearest centre. There are about as many cells as the square
    root of the number of points. Points without a vector are in cell 0 and never found.
    """
    spark = points.sparkSession
    total = points.count()
    drawn = points.select("vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    rows = matrix(drawn.column("vector")) if len(drawn) else np.zeros((0, 1))
    centres = trained(rows, n_cells or min(MOST_CELLS, max(1, round(total**0.5))), seed=seed)
    probes = probes_needed(rows, centres)
    sent = spark.sparkContext.broadcast(centres)
    others = [c for c in points.columns if c not in ("vector",)]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(batch.schema.get_field_index("vector")))
            near = np.nan_to_num(own @ sent.value.T, nan=-np.inf) if own.shape[1] else np.zeros((len(own), 1))
            cell = near.argmax(axis=1)
            cosine = near[np.arange(len(own)), cell]
            unit = pa.array([None if bad else row for bad, row in zip(np.isnan(own).any(axis=1), own.tolist())], pa.list_(pa.float64()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, unit, pa.array(cell.astype(np.int32)), pa.array(np.where(np.isinf(cosine), 1.0, cosine))], names=[*others, "vector", "cell", "cosine"])

    schema = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in others) + ", vector array<double>, cell int, cosine double"
    placed = points.select(*others, "vector").mapInArrow(assigned, schema)
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()}
    cells = [(c, centres[c].tolist(), float(found[c]["least"]) if c in found else 1.0, int(found[c]["n"]) if c in found else 0, max(1, -(-(found[c]["n"] if c in found else 0) // FILE_POINTS))) for c in range(len(centres))]
    table = spark.createDataFrame([(*c, probes, points.schema["id"].dataType.simpleString()) for c in cells], "cell int, centre array<double>, least double, size long, files int, probes int, id_type string")
    # The files of a large cell are filled by the hash of the id, so that no task takes a cell whole.
    rows_of = placed.drop("cosine").join(F.broadcast(table.select("cell", "files")), "cell")
    dealt = rows_of.withColumn("_file", F.pmod(F.xxhash64("id"), F.col("files"))).repartition("cell", "_file").drop("files", "_file")
    dealt.write.option("maxRecordsPerFile", FILE_POINTS).partitionBy("cell").parquet(f"{path}/points")
    table.drop("files").coalesce(1).write.parquet(f"{path}/cells")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return CellIndex(spark, path, np.array([r["centre"] for r in rows]), np.array([r["least"] for r in rows]), np.array([r["size"] for r in rows]), rows[0]["probes"], rows[0]["id_type"])


def _probed(index: CellIndex, block: Block, wanted: np.ndarray, k: int, scope: str | None, book: str | None, q_type) -> DataFrame | None:
    """The best points of the cells wanted (questions by cells); the other cells are not read."""
    cells = np.flatnonzero(wanted.any(axis=0))
    if not len(cells):
        return None
    by_cell = {int(c): np.flatnonzero(wanted[:, c]) for c in cells}

    def chosen(held: dict, own: Block) -> list[tuple[np.ndarray, np.ndarray]]:
        at = held["cell"].to_numpy()
        return [(np.flatnonzero(at == c), by_cell[int(c)]) for c in np.unique(at)]

    points = index.points().where(F.col("cell").isin([int(c) for c in cells]))
    return _searched(points, block, k, scope, book, chosen, q_type, ("cell",))


def search(questions: DataFrame, index: CellIndex, k: int = 20, probes: int | None = None, exact: bool = True, scope: str | None = None, book: str | None = None, full_scan: int = FULL_SCAN) -> tuple[DataFrame, float]:
    """``nearest`` through an index, and what part of all comparisons was made.

    The ``probes`` cells nearest to a question, as many as the index says, are read first. With ``exact`` every further cell in which,
    by its centre and the angle of its widest point, something could still be among the ``k`` best is
    read too: the result is that of the scan. Without it, what lies beyond the probes is
    missed. An index of fewer than ``full_scan`` points is scanned.
    """
    q_type, total = questions.schema["q"].dataType, int(index.sizes.sum())
    out, read, asked = None, 0.0, 0
    for block in blocks(questions, scope, book):
        asked += len(block.ids)
        if not len(block.ids) or not total:
            continue
        near, most = index.order(block.rows)
        wanted = np.zeros(near.shape, dtype=bool)
        count = near.shape[1] if total < full_scan else min(probes or index.probes, near.shape[1])
        np.put_along_axis(wanted, np.argsort(-near, axis=1, kind="stable")[:, :count], True, axis=1)
        wanted &= index.sizes[None, :] > 0
        found = _probed(index, block, wanted, k, scope, book, q_type)
        if exact and found is not None and not wanted[:, index.sizes > 0].all():
            held = _ranked(found, k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            bound = {r["q"]: r["least"] for r in held.where(F.col("n") == k).collect()}  # a row a question of the block
            least = np.array([bound.get(q, -np.inf) for q in block.ids])
            rest = ~wanted & (most + SLACK >= least[:, None])
            more = _probed(index, block, rest, k, scope, book, q_type)
            wanted |= rest
            found = found if more is None else found.unionByName(more)
        read += float((wanted * index.sizes[None, :]).sum())
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = questions.sparkSession.createDataFrame([], f"q {q_type.simpleString()}, id {index.id_type}, score double")
    return _ranked(out, k), read / max(1, asked * total)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(q, n, hit, recall): what part of the exact best an approximate search has found."""
    both = exact.select("q", "id").join(found.select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left")
    return both.groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("n"))


def new_path(folder: str) -> str:
    return f"{folder}/cells-{uuid.uuid4().hex}"
