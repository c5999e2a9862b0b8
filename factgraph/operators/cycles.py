"""Cycles by the back edges of a depth-first walk; no task holds more at once than a strongly connected component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.closure import reachable
from factgraph.sources.scratch import checkpointed

_EVENT = "array<struct<ord: long, src: string, dst: string>>"


def leading_on(edges: DataFrame) -> DataFrame:
    """Of stored edges (src, dst, ...) those that lead to a cycle.

    A node without an edge on leads nowhere; edges into such nodes go until there are none.
    There are as many rounds as the longest way out has steps.
    """
    while True:
        going = edges.select(F.col("src").alias("dst")).distinct()
        if edges.join(going, "dst", "left_anti").isEmpty():
            return edges
        edges = checkpointed(edges.join(going, "dst", "left_semi").select(*edges.columns))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _between_cycles(edges: DataFrame) -> DataFrame:
    """Of stored edges (src, dst) those that lead to a cycle and from one."""
    return leading_on(_turned(leading_on(_turned(edges))))


def _least_above(edges: DataFrame) -> DataFrame:
    """(id, least): the smallest id from which each node is reached, its own included. Only nodes that got another value pass theirs on."""
    labels = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("least"), F.lit(True).alias("moved")))
    while True:
        moved = labels.filter("moved").select(F.col("id").alias("src"), "least")
        if moved.isEmpty():
            return labels.select("id", "least")
        offers = edges.join(moved, "src").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("offer"))
        better = F.coalesce(F.col("offer") < F.col("least"), F.lit(False))
        labels = checkpointed(labels.join(offers, "id", "left").select("id", F.when(better, F.col("offer")).otherwise(F.col("least")).alias("least"), better.alias("moved")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (src, dst): each strongly connected component by its smallest id.

    Nodes that don't lie on a cycle, nor between cycles, are components of their own and
    are left out. Each round, every node takes the smallest id that reaches it; the nodes of
    that value which reach it back are its component, and no component spreads over
    two values. What is left is trimmed and goes round again. Null ends are left out.
    """
    found = edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    left = _between_cycles(checkpointed(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()))
    while not left.isEmpty():
        least = _least_above(left)
        value = lambda end: least.select(F.col("id").alias(end), F.col("least").alias(f"_{end}"))
        inside = checkpointed(left.join(value("src"), "src").join(value("dst"), "dst").filter("_src = _dst").select("src", "dst"))
        roots = least.filter("id = least").select("id")
        here = checkpointed(reachable(_turned(inside), roots).select("id").join(least, "id").select("id", F.col("least").alias("component")))
        found = found.unionByName(here)
        rest = inside.join(here.select(F.col("id").alias("src")), "src", "left_anti").join(here.select(F.col("id").alias("dst")), "dst", "left_anti")
        rest = checkpointed(rest.select("src", "dst"))
        left = rest if rest.isEmpty() else _between_cycles(rest)
    return found


#: A cycle, or an edge that leaves its component, and at which place of the walk.
_WALKED = "a string, src string, dst string, b string, at long, nodes array<string>"
#: Names that a batch of what was walked holds, or one cycle that has more.
_BATCH = 50_000


def _walk(own: str, first: str, edges: Iterable[tuple[str, str, str]]) -> Iterator[tuple]:
    """A component from its entry, by its sorted edges (src, dst, part): rows of cycles (nodes), and of edges that leave it, numbered as the walk looks at them."""
    graph: dict[str, list[tuple[str, str]]] = {}
    for a, b, part in edges:
        graph.setdefault(a, []).append((b, part))
    done, path, on_path, todo, n = {first}, [first], {first: 0}, [iter(graph[first])], 0
    while todo:
        for nxt, part in todo[-1]:
            n += 1
            if part != own:
                yield own, path[-1], nxt, part, n, None
            elif nxt in on_path:
                yield own, path[-1], nxt, part, n, path[on_path[nxt] :] + [nxt]
            elif nxt not in done:
                done.add(nxt)
                on_path[nxt] = len(path)
                path.append(nxt)
                todo.append(iter(graph[nxt]))
                break
        else:
            todo.pop()
            del on_path[path.pop()]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task one after the other, from rows (a, entry, src, dst, b) that lie together by a and are sorted there."""
    kinds = [pa.string()] * 4 + [pa.int64(), pa.list_(pa.string())]
    names = ["a", "src", "dst", "b", "at", "nodes"]
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    found, held = [], 0
    for (own, first), edges in groupby(rows, key=lambda row: row[:2]):
        for row in _walk(own, first, (e[2:] for e in edges)):
            found.append(row)
            held += 4 + len(row[-1] or ())
            if held >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                found, held = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def back_edge_cycles(edges: DataFrame) -> DataFrame:
    """One cycle for each back edge of a depth-first walk of edges (src, dst, maybe ord): (nodes, n).

    Nodes are begun with in the order of their first edges, and edges looked at in the order of
    ord, then src and dst; repeated edges are looked at each.

    A back edge never leaves a strongly connected component, and from where the walk enters one
    it sees all of it before it goes back, no matter what hangs on it. So each component is
    walked by itself, and only its entry depends on the others. The walk as a
    whole looks at edges in the order of their paths from a first node, so the entry
    is the node with the smallest such path: components are taken in the order of their
    dependence, each path is that of the component before it and the number of the edge
    there. There are as many rounds as components in a row, and a path has an element for
    each of them; edges that lead to no cycle are left out before.
    """
    ordered = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), (F.col("ord") if "ord" in edges.columns else F.lit(0)).cast("long").alias("ord")
    )
    ordered = checkpointed(ordered)
    rank = ordered.groupBy("src").agg(F.min(F.struct("ord", "src", "dst")).alias("rank"))
    on = leading_on(ordered)
    strong = strong_components(on)
    part = lambda end, out: strong.select(F.col("id").alias(end), F.col("component").alias(out))
    own = on.join(part("src", "a"), "src", "left").join(part("dst", "b"), "dst", "left")
    own = checkpointed(own.select("src", "dst", "ord", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"), F.col("a").isNotNull().alias("strong")).join(rank, "src"))
    todo = checkpointed(own.select("a").distinct())
    links = own.filter("a != b").select("a", "b").distinct()
    out = events = None
    while out is None or not todo.isEmpty():
        waiting = links.join(todo, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        ready = checkpointed(todo.join(waiting, "a", "left_anti"))
        here = own.join(ready, "a", "left_semi")
        ways = here.select("a", F.col("src").alias("node"), F.array("rank").cast(_EVENT).alias("path"))
        if events is not None:
            ways = ways.unionByName(events.join(ready.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("b").alias("a"), F.col("dst").alias("node"), "path"))
        entry = checkpointed(ways.groupBy("a").agg(F.min(F.struct("path", "node")).alias("way")).select("a", F.col("way.node").alias("entry"), "way.path"))
        # many small components are a task's stream of rows: a call for each would cost far more than its walk
        strongly = here.filter("strong").join(entry.select("a", "entry"), "a").repartition("a").sortWithinPartitions("a", "ord", "src", "dst")
        walked = checkpointed(strongly.select("a", "entry", "src", "dst", "b").mapInArrow(_walks, _WALKED))
        out = walked.filter("nodes IS NOT NULL") if out is None else out.unionByName(walked.filter("nodes IS NOT NULL"))
        done = todo.join(ready, "a", "left_anti")
        todo = checkpointed(done)
        step = lambda *by: F.concat("path", F.array(F.struct(*by)).cast(_EVENT)).alias("path")
        alone = here.filter("NOT strong").join(entry, "a").select("b", "dst", step(F.col("ord"), F.col("dst"), F.lit("")))
        left = walked.filter("nodes IS NULL").join(entry, "a").select("b", "dst", step(F.col("at"), F.lit(""), F.lit("")))
        new = alone.unionByName(left)
        events = new if events is None else checkpointed(events.unionByName(new))
    return out.select("nodes", (F.size("nodes") - 1).alias("n"))
