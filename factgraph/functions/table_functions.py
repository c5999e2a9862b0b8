"""Walks over one group of rows as table functions for SQL.

SELECT * FROM back_edges(TABLE(edges) PARTITION BY part ORDER BY ord). Spark deals the groups to tasks and
sorts them; a function sees its group's rows one after the other. Result types follow the
argument's, so ids can be of any type. register(spark) makes all of TABLE_FUNCTIONS known.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _field(table: AnalyzeArgument, name: str):
    """The type of a column of a table argument."""
    if not table.isTable:
        raise ValueError("give a table: TABLE(name) PARTITION BY ... ORDER BY ...")
    for f in table.dataType.fields:
        if f.name.lower() == name:
            return f.dataType
    raise ValueError(f"the table has no column {name}")


class BackEdges:
    """(nodes, n): one cycle for each back edge of a depth-first walk of edges (src, dst), in the order of their rows.

    A group should be a strongly connected component, begun with at its first row, or anything that holds whole ones.
    """

    @staticmethod
    def analyze(edges: AnalyzeArgument) -> AnalyzeResult:
        kind = _field(edges, "src")
        if _field(edges, "dst") != kind:
            raise ValueError("src and dst differ in type")
        return AnalyzeResult(StructType().add("nodes", ArrayType(kind)).add("n", IntegerType()))

    def __init__(self):
        self.out: dict = {}

    def eval(self, row: Row) -> None:
        if row["src"] is not None and row["dst"] is not None:
            self.out.setdefault(row["src"], []).append(row["dst"])

    def terminate(self) -> Iterator[tuple]:
        done = set()
        for first in self.out:
            if first in done:
                continue
            path, place, todo = [first], {first: 0}, [iter(self.out[first])]
            done.add(first)
            while todo:
                for nxt in todo[-1]:
                    if nxt in place:
                        cycle = path[place[nxt] :] + [nxt]
                        yield cycle, len(cycle) - 1
                    elif nxt not in done:
                        done.add(nxt)
                        place[nxt] = len(path)
                        path.append(nxt)
                        todo.append(iter(self.out.get(nxt, ())))
                        break
                else:
                    todo.pop()
                    del place[path.pop()]


class Bursts:
    """(first, last, n): runs of rows in the order of `at` (a number) of which none is more than `gap` after the one before it."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        kind = _field(rows, "at")
        return AnalyzeResult(StructType().add("first", kind).add("last", kind).add("n", LongType()))

    def __init__(self):
        self.first = self.last = None
        self.n = 0

    def eval(self, row: Row, gap) -> Iterator[tuple]:
        at = row["at"]
        if at is None:
            return
        if self.n and at - self.last > gap:
            yield self.first, self.last, self.n
            self.n = 0
        if not self.n:
            self.first = at
        self.last, self.n = at, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.first, self.last, self.n


class OpenIntervals:
    """(at, open): how many intervals (low, high), in the order of low, are open when each begins, itself included.

    Held are only the ends of those that are open.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        kind = _field(rows, "low")
        _field(rows, "high")
        return AnalyzeResult(StructType().add("at", kind).add("open", IntegerType()))

    def __init__(self):
        self.ends: list = []

    def eval(self, row: Row) -> Iterator[tuple]:
        import heapq

        if row["low"] is None or row["high"] is None:
            return
        while self.ends and self.ends[0] < row["low"]:
            heapq.heappop(self.ends)
        heapq.heappush(self.ends, row["high"])
        yield row["low"], len(self.ends)


#: All table functions, under their names in SQL.
TABLE_FUNCTIONS = {"back_edges": BackEdges, "bursts": Bursts, "open_intervals": OpenIntervals}


def register(spark: SparkSession) -> None:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
