"""Cycles and communities that are spread over tasks, against the sequential walks that define them."""

import random

import pytest

from factgraph.operators import cycles, graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, ord long, weight long").repartition(3)


def walked(edges):
    """All back edges of one sequential walk."""
    out = {}
    for a, b, *_ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        out.setdefault(a, []).append(b)
    done, found = set(), []

    def enter(node, path):
        done.add(node)
        for nxt in out.get(node, ()):
            if nxt in path:
                found.append((*path[path.index(nxt) :], nxt))
            elif nxt not in done:
                enter(nxt, [*path, nxt])

    for node in out:
        if node not in done:
            enter(node, [node])
    return sorted(found)


def propagated(edges, iterations):
    """Labels in place, node by node."""
    near = {}
    for a, b, _, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})
            near[x][y] = near[x].get(y, 0) + w
    labels = {n: n for n in near}
    for _ in range(iterations):
        before = dict(labels)
        for n in sorted(near):
            weights = {}
            for other, w in near[n].items():
                weights[labels[other]] = weights.get(labels[other], 0) + w
            labels[n] = max(weights, key=weights.__getitem__)
        if labels == before:
            break
    return labels


def many_graphs(seed):
    """Graphs of several shapes beside each other: sparse, dense, chains of cycles, tails, self-edges, repeated edges."""
    r, out = random.Random(seed), []
    for g in range(70):
        nodes = [f"{g}-{chr(97 + i)}" for i in r.sample(range(12), r.randint(2, 12))]
        for _ in range(r.randint(1, 4) * len(nodes) // 2 + 1):
            a, b = r.choice(nodes), r.choice(nodes)
            if g % 3 == 0 and r.random() < 0.8:
                a, b = sorted((a, b))  # nearly acyclic: small components in long rows
            out.append((a, b, r.randint(0, 5) if g % 2 else 0, r.randint(1, 3)))
    for k in range(6):  # a row of cycles, entered from both ends' tails
        ring = [f"row-{k}{x}" for x in "abc"]
        out += [(a, b, r.randint(0, 9), 1) for a, b in zip(ring, ring[1:] + ring[:1])]
        out += [(r.choice(ring), f"row-{k + 1}{r.choice('abc')}", r.randint(0, 9), 1) for _ in range(2) if k < 5]
    return out + [("tail", "row-2b", 0, 1), ("head", "tail", 1, 1), ("row-5a", "end", 0, 1), ("end", "finish", 0, 1)]


def test_cycles_like_one_walk(spark):
    edges = many_graphs(1)
    assert sorted(tuple(r.nodes) for r in cycles.back_edge_cycles(frame(spark, edges)).collect()) == walked(edges)


def test_strong_components(spark):
    edges = many_graphs(3)
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    reached = {n: reach(n) for n in {x for e in edges for x in e[:2]}}
    on_cycle = {n for n in reached if n in reached[n]}
    found = {r.id: r.component for r in cycles.strong_components(frame(spark, edges)).collect()}
    assert {n: c for n, c in found.items() if n in on_cycle} == {n: min(m for m in reached[n] if n in reached[m]) for n in on_cycle}
    assert all(found[n] == n for n in found if n not in on_cycle)


@pytest.mark.parametrize("iterations", [2, 20])
def test_communities_like_one_walk(spark, iterations):
    edges = many_graphs(4)
    assert {r.id: r.label for r in graph.communities_exact(frame(spark, edges), iterations).collect()} == propagated(edges, iterations)


def test_long_chains_end(spark):
    """A label goes down a whole chain in one round."""
    edges = [(f"{i:03d}", f"{i + 1:03d}", 0, 100 - i) for i in range(30)]
    assert {r.id: r.label for r in graph.communities_exact(frame(spark, edges)).collect()} == propagated(edges, 20)


def test_empty_and_null_edges(spark):
    none = frame(spark, [])
    assert cycles.back_edge_cycles(none).count() == graph.communities_exact(none).count() == cycles.strong_components(none).count() == 0
    odd = frame(spark, [("a", None, 0, 1), (None, "a", 0, 1), ("a", "a", 0, 1)])
    assert [r.nodes for r in cycles.back_edge_cycles(odd).collect()] == [["a", "a"]]
    assert {r.id: r.label for r in graph.communities_exact(odd).collect()} == {"a": "a"}
