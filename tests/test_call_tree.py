"""The call tree by a fix point over keys of paths, against one walk."""

import random

import pytest

from factgraph.operators import graph


def walked(calls, root, depth):
    out, rows, seen = {}, [], set()
    for a, b, ord in sorted(calls, key=lambda c: (c[2], c[1])):
        out.setdefault(a, []).append(b)

    def visit(path):
        rows.append((len(rows), tuple(path), path[-1], len(path) - 1))
        if path[-1] in seen or len(path) > depth:
            return
        seen.add(path[-1])
        for b in out.get(path[-1], ()):
            visit([*path, b])

    visit([root])
    return rows


def frame(spark, calls):
    return spark.createDataFrame(calls, "caller string, callee string, ord long").repartition(3)


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_like_one_walk(spark, depth):
    r = random.Random(depth)
    nodes = [f"m{i}" for i in range(9)]
    calls = [(r.choice(nodes), r.choice(nodes), r.randint(0, 4)) for _ in range(26)] + [("m0", "m1", 0)] * 2
    found = graph.dependency_tree(frame(spark, calls), "m0", depth).orderBy("pos").collect()
    assert [(x.pos, tuple(x.path), x.node, x.depth) for x in found] == walked(calls, "m0", depth)


def test_cut_off_by_depth(spark):
    """x is met first on the last level, where it isn't expanded; the later, higher one is, and so is what hangs on it."""
    calls = [("r", "a", 0), ("a", "b", 0), ("b", "x", 0), ("r", "x", 1), ("x", "y", 0), ("y", "b", 0)]
    found = graph.dependency_tree(frame(spark, calls), "r", 3).orderBy("pos").collect()
    assert [(x.pos, tuple(x.path), x.node, x.depth) for x in found] == walked(calls, "r", 3)


def test_roots(spark):
    calls = frame(spark, [("a", "b", 0), ("b", None, 0)])
    assert [r.node for r in graph.dependency_tree(calls, "z").collect()] == ["z"] and graph.dependency_tree(calls, "").count() == 0
    none = spark.createDataFrame([], "id string")
    assert graph.dependency_tree(calls, none).count() == 0 and graph.dependency_tree(calls.limit(0), "a").count() == 1
