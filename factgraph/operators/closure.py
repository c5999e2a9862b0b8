"""Reachability and connected components of edge tables, by rounds that are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None, fold: bool = False) -> DataFrame:
    """(id, depth): nodes reached from the ids of start, with the fewest steps; start itself is at 0.

    Each round joins only the nodes found in the round before, drops those known
    (left anti) and stops when none is new. fold: ids are compared ignoring case.
    Every round is checkpointed, so that plans stay short and nothing is held in memory;
    the driver sees one row a round.
    """
    key = F.lower if fold else F.col
    # edges stay repeated, and are chosen by a semi-join, which goes below what makes them: else each round groups all of them
    edges = edges.select(key("src").alias("src"), key("dst").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    front = start.select(key("id").alias("id")).distinct()
    found, depth = front.withColumn("depth", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = edges.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        new = _cut(new)
        if new.isEmpty():
            break
        found = found.unionByName(new.withColumn("depth", F.lit(depth)))
        if depth % 4 == 0:
            found = _cut(found)
        front = new
    return found


def _cut(df: DataFrame, _: str = "") -> DataFrame:
    from factgraph.sources.scratch import checkpointed

    return checkpointed(df)


def _large_star(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each node points its larger neighbours at its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that both sides of the join are plain shuffles, whose large partitions Spark can split
    low = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours and itself at the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _cut) -> DataFrame:
    """(id, component) for each node of edges (a, b): the smallest id that it reaches. By alternating stars.

    Edges with a null end or a = b are left out. keep stores a round (a table and a name
    for it) and gives it back; two counts are all that the driver sees. The rounds grow
    with the logarithm of the longest path, and a node with very many neighbours is an
    aggregate and a splittable join, never a collected list.
    """
    edges = keep(edges.filter("a != b").select("a", "b").distinct(), "edges")
    last = None
    while True:
        edges = keep(_small_star(keep(_large_star(edges, keep), "large-star")), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
    tree = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return tree.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


#: Steps that a closure takes one by one; from there on it takes as many as it has.
_SINGLE = 8


def transitive_closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) of all pairs joined by a path, with the fewest steps; (x, x) only on cycles.

    The first rounds go a step on. Where paths are longer, the pairs that lie as far apart as any go on by
    all that is known of their ends, so known distances double: a chain of n takes about log2(n) rounds more.
    """
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    found, front, depth = edges.withColumn("depth", F.lit(1)), edges, 1
    while max_depth is None or depth < max_depth:
        if depth >= _SINGLE:
            far, on = found.filter(F.col("depth") == depth).alias("f"), found.alias("e")
            step = far.join(on, F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst", (F.col("f.depth") + F.col("e.depth")).alias("depth"))
            step = step if max_depth is None else step.filter(F.col("depth") <= max_depth)
            new = _cut(step.groupBy("src", "dst").agg(F.min("depth").alias("depth")).join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
            if new.isEmpty():
                break
            found, depth = _cut(found.unionByName(new)), depth * 2
            continue
        depth += 1
        step = front.alias("f").join(edges.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst").distinct()
        new = step.join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        new = _cut(new)
        if new.isEmpty():
            break
        found = found.unionByName(new.withColumn("depth", F.lit(depth)))
        if depth % 4 == 0:
            found = _cut(found)
        front = new
    return found


def bounded_paths(edges: DataFrame, start: DataFrame, depth: int, stubs: bool = False) -> DataFrame:
    """(root, path, node, depth, is_stub): all paths of up to `depth` steps that repeat no node.

    stubs: a node that is on its own path already is given once more, and not extended.
    """
    edges = edges.select("src", "dst")
    front = start.select(F.col("id").alias("root"), F.array("id").alias("path"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("is_stub"))
    out = front
    for d in range(1, depth + 1):
        step = front.filter("NOT is_stub").join(edges, F.col("node") == F.col("src")).select(
            "root", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("node"), F.lit(d).alias("depth"), F.array_contains("path", F.col("dst")).alias("is_stub")
        )
        front = step if stubs else step.filter("NOT is_stub")
        out = out.unionByName(front)
    return out
