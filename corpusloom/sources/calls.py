"""Calls to remote models from tasks: in batches, some at once, in order, again after a pause.

A task keeps a bounded number of calls open and gives their results in the order of its rows,
so neither a slow call nor a long partition piles up in memory.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Calls:
    """How calls are made: rows in one, calls at once in a task, tries of each, the longest pause."""

    size: int = 10
    at_once: int = 10
    tries: int = 6
    longest: float = 120.0
    pause: Callable[[float], None] = time.sleep

    def seconds(self, attempt: int, asked: float | None) -> float:
        """The pause ahead of another try: what the service asked for, or twice as long each time with some chance."""
        return min(asked if asked is not None else 2.0 ** min(attempt, 4) + random.random(), self.longest)


class Again(Exception):
    """A call that should be made again, after ``seconds`` if the service said how long."""

    def __init__(self, reason: str = "", seconds: float | None = None) -> None:
        super().__init__(reason)
        self.seconds = seconds


def tried(call: Callable[[list], list], rows: list, how: Calls) -> list:
    """One call, made again whenever it raises ``Again``; another error, or the last ``Again``, is raised."""
    for attempt in range(how.tries):
        try:
            found = call(rows)
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} results for {len(rows)} rows")
            return found
        except Again as reason:
            if attempt + 1 == how.tries:
                raise
            how.pause(how.seconds(attempt, reason.seconds))
    raise AssertionError("no try was made")


def in_order(rows: Iterable[object], call: Callable[[list], list], how: Calls) -> Iterator[object]:
    """The results of all rows in order; at most ``at_once`` calls are open and as many rows are held as they have."""
    with ThreadPoolExecutor(how.at_once) as pool:
        open_: deque[Future] = deque()
        held: list = []

        def sent() -> None:
            open_.append(pool.submit(tried, call, list(held), how))
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == how.size:
                sent()
            if len(open_) > how.at_once:
                yield from open_.popleft().result()
        if held:
            sent()
        while open_:
            yield from open_.popleft().result()


def with_calls(rows: DataFrame, column: str, result: str, kind: str, call: Callable[[list], list], how: Calls = Calls()) -> DataFrame:
    """``rows`` with a column ``result`` of type ``kind``: what ``call`` gives for lists of values of ``column``.

    ``call`` runs in the tasks and raises ``Again`` for what should be tried again. A null value is not sent and has a null
    result. Rows of a batch are dealt to calls in their order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = [v for v in batch[column] if v is not None]
            answers = in_order(sent, call, how)
            yield batch.assign(**{result: pd.Series([None if v is None else next(answers) for v in batch[column]], index=batch.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{result}` {kind}")
