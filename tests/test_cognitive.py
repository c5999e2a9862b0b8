"""Cognitive complexity by running sums, against a fold of each tree from its root."""

import random

from factgraph.operators import metrics

KINDS = ["IfStatement"] * 6 + ["ElseClause"] * 3 + ["Block", "Block", "ForStatement", "SwitchStatement", "LogicalAndExpression", "SimpleLambdaExpression", "IdentifierName", "ReturnStatement", "ConditionalExpression"]


def tree(r, owner, doc, first):
    """A random tree: rows (doc, node, parent, pre, post, kind, owner)."""
    rows, n = [], first

    def grow(parent, depth):
        nonlocal n
        here = n
        n += 1
        row = [doc, here, parent, here, here, r.choice(KINDS), owner]
        rows.append(row)
        for _ in range(r.choice((0, 1, 1, 2, 3)) if depth < 7 else 0):
            grow(here, depth + 1)
        row[4] = n - 1

    for _ in range(r.randint(1, 3)):
        grow(-1, 0)
    return [tuple(x) for x in rows], n


def folded(rows):
    kind = {x[1]: x[5] for x in rows}
    children = {}
    for x in rows:
        children.setdefault(x[2], []).append(x[1])

    def cost(node, nesting):
        total = 0
        for c in children.get(node, ()):
            k, below = kind[c], children.get(c, ())
            if k == "IfStatement":
                total += 1 + nesting
                for b in [x for x in below if kind[x] != "ElseClause"][-1:]:
                    total += cost(b, nesting + 1)
                for e in (x for x in below if kind[x] == "ElseClause"):
                    total += 1 + cost(e, nesting + (not any(kind[x] == "IfStatement" for x in children.get(e, ()))))
            elif k in metrics.NESTING:
                total += 1 + nesting + cost(c, nesting + 1)
            else:
                total += (k in metrics.FLAT) + cost(c, nesting + (k in metrics.LAMBDAS))
        return total

    return cost(-1, 0)


def test_like_folds_of_random_trees(spark):
    r, rows, want, at = random.Random(6), [], {}, 0
    for m in range(400):
        at = at if m % 3 else 0  # several methods of a document share its numbers
        own, at = tree(r, f"M{m}", m // 3, at)
        rows += own
        want[f"M{m}"] = folded(own)
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, parent_id int, pre int, post int, kind string, owner_symbol string").repartition(3)
    assert {x.owner_symbol: x.cognitive for x in metrics.cognitive(nodes).collect()} == want and max(want.values()) > 20


def test_rows_of_direct_ifs(spark):
    """`if (a) if (b) if (c) x;`: every second one is the statement of one that counts."""
    rows = []
    for i in range(6):
        rows += [(1, 2 * i, 2 * i - 2 if i else -1, 2 * i, 11, "IfStatement", "M"), (1, 2 * i + 1, 2 * i, 2 * i + 1, 2 * i + 1, "LogicalOrExpression", "M")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, parent_id int, pre int, post int, kind string, owner_symbol string")
    assert metrics.cognitive(nodes).first().cognitive == folded(rows)


def test_no_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, -1, 0, 0, "Block", "M"), (1, 1, -1, 1, 1, "IfStatement", None)], "doc_id long, node_id int, parent_id int, pre int, post int, kind string, owner_symbol string")
    assert [tuple(r) for r in metrics.cognitive(nodes).collect()] == [("M", 0)] and metrics.cognitive(nodes.limit(0)).count() == 0
