"""What the fourth review found."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.operators import binding, graph, propagation
from factgraph.operators.propagation import Blocks
from factgraph.sources import csharp_tree
from factgraph.sources.scratch import CLEANED, checkpointed
from tests.test_cycles import propagated


def shuffle_bytes(spark):
    """In the folders of this application's block manager."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.stat(os.path.join(at, f)).st_size for folder in found for at, _, files in os.walk(folder) for f in files if f.startswith("shuffle_") and f.endswith(".data"))


def test_shuffles_of_stored_rounds_do_not_stay_on_disk(spark):
    before, said = shuffle_bytes(spark), spark.conf.get(CLEANED)
    rows = spark.range(200_000).selectExpr("id", "sha2(string(id), 256) AS h")
    for _ in range(3):
        rows = checkpointed(rows.repartition(4, "h"))
    assert rows.count() == 200_000 and shuffle_bytes(spark) - before < 1_000_000
    assert spark.conf.get(CLEANED) == said


def test_a_round_sends_rows_between_blocks_not_edges(spark, monkeypatch):
    monkeypatch.setattr(propagation, "_LEAST", 500)
    pick = random.Random(5)
    pairs = [(pick.randrange(200), pick.randrange(200)) for _ in range(3_000)]
    blocks = Blocks(spark.createDataFrame(pairs, "src long, dst long"), in_place=False)
    try:
        sent = blocks.sent(blocks.start())
        assert 4 < blocks.blocks < 20 and sent.count() <= blocks.blocks * (blocks.blocks + 1)
        assert dict(blocks.near.dtypes)["slots"] == "array<int>" and blocks.near.count() == 200
        # the table of edges stays where it is
        held = blocks.sync_round(blocks.start())
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert not any("slots" in line for line in plan.splitlines() if "Exchange" in line)
        assert plan.count("Bucketed: true") >= 2
    finally:
        blocks.drop()
    assert not spark.catalog.tableExists(blocks.name)


@pytest.mark.parametrize("shift", [0, -7, 3_000_000_000])
def test_members_walk_like_edges(spark, monkeypatch, shift):
    """Numbers of any size, in several blocks, as groups and as edges."""
    monkeypatch.setattr(propagation, "_LEAST", 200)
    pick = random.Random(shift)
    groups = [sorted({pick.randrange(60) + shift for _ in range(pick.randrange(1, 6))}) for _ in range(200)]
    pairs = [(a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
    members, edges = spark.createDataFrame([(g,) for g in groups], "members array<long>"), spark.createDataFrame(pairs, "src long, dst long")
    walked = {int(x) - 7: int(y) - 7 for x, y in propagated([(f"{a + 7:011d}", f"{b + 7:011d}", 0, 1) for a, b in pairs], 20).items()}
    for given in (members, edges):
        assert {r.id: r.label for r in graph.communities_numbered(given).collect()} == walked


def synced(pairs, rounds):
    around = {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                around.setdefault(x, {}).setdefault(y, 0)
                around[x][y] += 1
    labels = {x: x for x in around}
    for _ in range(rounds):
        weight = {x: {} for x in around}
        for x, ys in around.items():
            for y, w in ys.items():
                weight[x][labels[y]] = weight[x].get(labels[y], 0) + w
        labels = {x: min(ws, key=lambda n: (-ws[n], n)) for x, ws in weight.items()}
    return labels


@pytest.mark.parametrize("shift", [0, -7, 3_000_000_000])
def test_members_are_edges_of_blocks(spark, monkeypatch, shift):
    """Numbers of any size, in several blocks, as groups and as edges."""
    monkeypatch.setattr(propagation, "_LEAST", 200)
    pick = random.Random(shift)
    groups = [sorted({pick.randrange(60) + shift for _ in range(pick.randrange(1, 6))}) for _ in range(200)]
    pairs = [(a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
    members, edges = spark.createDataFrame([(g,) for g in groups], "members array<long>"), spark.createDataFrame(pairs, "src long, dst long")
    expected = synced(pairs, 3)
    for given in (members, edges):
        assert {r.id: r.label for r in graph.communities_sync(given, 3).collect()} == expected
    stats = {r.label: (r.members, round(r.cohesion, 9)) for r in graph.communities_sync_stats(members, 3, most=None).collect()}
    labels = spark.createDataFrame(list(expected.items()), "id long, label long")
    assert stats == {r.label: (r.members, round(r.cohesion, 9)) for r in graph.community_stats(labels, edges, most=None).collect()}


def test_names_are_labels_of_rounds_at_once(spark):
    pairs = [("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("x", None)]
    found = graph.communities_sync(spark.createDataFrame(pairs, "src string, dst string"), 4)
    assert {r.id: r.label for r in found.collect()} == synced(pairs[:4], 4)
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.communities_sync(none).count() == graph.communities_sync_stats(none).count() == graph.communities_numbered(none).count() == 0


def test_the_heaviest_label_of_large_numbers():
    node, weight = np.array([0, 0, 0, 2, 2]), np.array([1, 1, 2, 5, 5], "int32")
    label = np.array([1 << 40, 1 << 40, 9, 7, 3])
    assert [x.tolist() for x in propagation.heaviest(node, label, weight, True)] == [[0, 2], [9, 3]]
    assert [x.tolist() for x in propagation.heaviest(node, label, weight, False)] == [[0, 2], [1 << 40, 7]]


def shuffled_rows(spark, run):
    """How many rows were written for others while run() ran."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def wrote():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = wrote()
    run()
    return sum(n for stage, n in wrote().items() if stage not in before)


def test_what_stands_around_locals_is_picked_out_of_the_nodes(spark):
    """Each of five joins shuffled all nodes, in one job."""
    chain = "".join(".Next()" for _ in range(25))
    text = f"namespace N; class Order {{ Order Next() {{ return this; }} }} class Use {{ Order o; void Go() {{ var a = o; var b = a; foreach (Order c in b) {{ c{chain}; }} b{chain}; }} }}"
    docs = spark.range(40).selectExpr("id AS doc_id", "'P' AS project", "concat(id, '.cs') AS file_path", "id AS doc_ord").withColumn("text", F.lit(text))
    nodes, symbols = checkpointed(csharp_tree.syntax_nodes(docs)), checkpointed(csharp_tree.declared_symbols(docs))
    found = []
    wrote = shuffled_rows(spark, lambda: found.extend(binding.local_names(nodes, symbols).collect()))
    assert wrote < 4 * nodes.count()
    names = {(r.name, r.written, r.value_id is not None) for r in found if r.doc_id == 7}
    assert names == {("a", "var", True), ("b", "var", True), ("c", "Order", False)} and len(found) == 3 * 40


def test_declarations_are_read_without_parsing_bodies(monkeypatch):
    text = "namespace N; class A { int M(int a) { return a; } string P => x; B Go() => this.M(1); }"
    facts = [(d, f) for d, f, _, _ in csharp_tree.methods(text)]
    monkeypatch.setattr(csharp_tree, "Parser", None)
    assert [(d, f) for d, f, body, _ in csharp_tree.methods(text, bodies=False) if body is None] == facts and len(facts) == 2
