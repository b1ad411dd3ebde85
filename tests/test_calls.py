"""Calls in batches: order, bounds, pauses, and what is not tried again."""

import threading
import time

import pytest

from corpusloom.sources.calls import Again, Calls, in_order, tried, with_calls


class Service:
    """Counts calls and how many are open at once; the first tries of some rows are refused."""

    def __init__(self, refused=()):
        self.lock, self.open, self.most, self.calls, self.left = threading.Lock(), 0, 0, [], dict(refused)

    def __call__(self, rows):
        with self.lock:
            self.open, self.calls = self.open + 1, [*self.calls, list(rows)]
            self.most = max(self.most, self.open)
            refuse = self.left.get(rows[0], 0)
            self.left[rows[0]] = refuse - 1
        time.sleep(0.01)
        with self.lock:
            self.open -= 1
        if refuse > 0:
            raise Again("busy", 7.0 if rows[0] == 0 else None)
        return [r * 2 for r in rows]


def test_results_come_in_order_with_few_calls_open():
    pauses = []
    service = Service({0: 2, 30: 1})
    how = Calls(size=10, at_once=3, pause=pauses.append)
    assert list(in_order(range(95), service, how)) == [2 * n for n in range(95)]
    assert service.most <= 3 and len(service.calls) == 10 + 3 and max(map(len, service.calls)) == 10
    assert pauses.count(7.0) == 2 and len(pauses) == 3 and all(1 <= p <= 7 for p in pauses)


def test_pauses_grow_to_a_bound_and_tries_end():
    how = Calls(tries=4, longest=5.0, pause=lambda s: None)
    assert [int(how.seconds(n, None)) for n in range(3)] == [1, 2, 4] and how.seconds(9, None) == 5.0 and how.seconds(0, 400.0) == 5.0
    with pytest.raises(Again):
        tried(Service({1: 9}), [1], how)
    with pytest.raises(ValueError):
        tried(lambda rows: [], [1], how)
    with pytest.raises(ZeroDivisionError):
        list(in_order([1, 2], lambda rows: 1 / 0, how))


def test_a_column_of_results(spark):
    rows = spark.createDataFrame([(n, f"t{n}" if n % 7 else None) for n in range(50)], "id long, text string").repartition(3)
    found = with_calls(rows, "text", "size", "int", lambda texts: [len(t) for t in texts], Calls(size=4, at_once=2))
    assert {r["id"]: r["size"] for r in found.collect()} == {n: len(f"t{n}") if n % 7 else None for n in range(50)}
    assert with_calls(rows.where("false"), "text", "size", "int", lambda texts: [1 / 0]).count() == 0
