"""What the third review found: tables on which queries and their SQL parted."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factgraph.operators import closure, cycles, graph
from factgraph.operators.name_index import NameIndex
from factgraph.sources import csharp, csharp_flow, csharp_tree
from factgraph.sources.scratch import checkpointed
from factgraph.streaming.settle import Settle
from tests.test_cycles import propagated, walked
from tests.test_queries import canonical


@pytest.fixture
def held(spark, tmp_path):
    """Writes tables, and holds a query on them against its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found, expected = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        assert canonical(found) == canonical(expected)
        return found

    return run


@pytest.fixture
def turns(spark):
    """A user opens conversation 12, a system the one whose name is near."""
    rows = [(2, 0, "system"), (2, 1, "user"), (2, 2, "assistant"), (12, 0, "user"), (12, 1, "assistant")]
    return spark.createDataFrame([(c, t, r, "") for c, t, r in rows], "conv_id long, turn int, role string, text string")


def test_implementations_of_a_first_turn_of_a_user(held, turns):
    assert list(held("implementations", conversations=turns)["display"]) == ["12/1"]


def test_pages_that_share_a_path(held, spark):
    urls = ["http://a.example/x", "https://a.example/x", "https://a.example/y", "https://a.example/y"]
    assert len(held("solution_discovery", pages=spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"))) == 4


def test_overview_of_a_first_turn_of_a_user(held, turns):
    assert "implementations" in set(held("type_overview", conversations=turns)["part"])


@pytest.mark.parametrize(
    "own",
    [
        [(1, "user"), (2, "assistant"), (2, None), (4, "assistant")],
        [(-1, "system"), (0, "assistant"), (0, "assistant"), (1, "user"), (1, "assistant")],
        [],
    ],
)
def test_overview_of_a_conversation_of_any_turns(held, spark, own):
    """No first turn and gaps, repeated turns, no such conversation; the others have near names."""
    rows = [(c, t, "user", "") for c in (2, 11, 13, 112) for t in range(2)] + [(12, t, r, "") for t, r in own]
    assert len(held("type_overview", conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))) >= len(own)


def test_a_stored_table_is_not_taken_for_its_bytes_on_disk(spark):
    """Syntax nodes take less than a byte a row on disk: ten million rows were broadcast."""
    nodes = checkpointed(spark.range(2_000_000).selectExpr("id DIV 100 AS doc_id", "id % 100 AS node_id", "'Block' AS kind", "concat('N', id DIV 100, '.Use.Go') AS owner_symbol"))
    plan = nodes.join(nodes.select("doc_id", F.col("node_id").alias("above"), F.col("kind").alias("_k"), F.col("owner_symbol").alias("_o")), "doc_id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    few = checkpointed(spark.range(5).selectExpr("id AS doc_id"))
    assert "BroadcastHashJoin" in nodes.join(few, "doc_id")._jdf.queryExecution().sparkPlan().toString()


def test_a_round_of_a_walk_groups_no_edges_that_it_does_not_follow(spark, monkeypatch):
    """All edges were made distinct in each round, in memory that grew with them."""
    rounds, cut = [], closure._cut
    monkeypatch.setattr(closure, "_cut", lambda df, _="": rounds.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.range(60).selectExpr("id % 10 AS src", "id % 10 + 1 AS dst").distinct()
    found = closure.reachable(edges, spark.range(7, 8), 2)
    assert sorted(map(tuple, found.collect())) == [(7, 0), (8, 1), (9, 2)]
    assert all("Aggregate" not in plan.split("LeftSemi")[1].split("Range")[0] for plan in rounds)


def test_many_small_components_are_walked_as_one_stream(spark, monkeypatch):
    """Each was a call of its own on a frame of its own, and all of them were one task: 8 ms for two edges."""
    calls, walks = [], cycles._walks
    monkeypatch.setattr(cycles, "_BATCH", 50)
    few = [(f"n{i}", f"n{i + d}", d) for i in range(0, 120, 4) for d in (1, 2)] + [(f"n{i + d}", f"n{i}", d) for i in range(0, 120, 4) for d in (1, 2)]
    few += [("n0", "n4", 0)]
    edges = spark.createDataFrame(few, "src string, dst string, ord int")
    assert sorted(tuple(r.nodes) for r in cycles.back_edge_cycles(edges).collect()) == walked([(a, b, n) for a, b, n in few])
    rows = [(f"c{i}", f"{i}a", f"{i}{a}", f"{i}{b}", f"c{i}") for i in range(30) for a, b in ("ab", "ac", "ba", "ca")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("a", "entry", "src", "dst", "b"), r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    found = [r for batch in walks(iter(batches)) for r in calls.append(batch.num_rows) or batch.to_pylist()]
    assert [r["nodes"] for r in found] == [[f"{i}a", f"{i}{x}", f"{i}a"] for i in range(30) for x in "bc"] and 1 < len(calls) < 10


def test_documents_without_a_text_are_copies(held, spark):
    rows = [(1, None), (2, "a"), (3, None), (4, "a"), (5, "b"), (6, None), (7, "")]
    assert len(held("circular_dependencies_walk", documents=spark.createDataFrame(rows, "doc_id long, text string"))) == 3


@pytest.mark.parametrize("guessed", [False, True])
def test_stored_rounds_are_not_broadcast_by_megabytes(spark, guessed):
    """Each went through the driver up to 10 MB, at run time or where a union was taken for its stored parts."""
    rows = checkpointed(spark.range(60_000).selectExpr("sha2(string(id), 256) AS k", "id % 7 AS n"))
    some = rows.repartition(4, "k")
    if guessed:
        some = some.join(rows.filter("n > 0").select("k").distinct(), "k", "left_semi")
        some = some.unionByName(rows.filter("n < 0"))
    held = rows.join(some.withColumnRenamed("n", "m"), "k")
    held.collect()
    assert "BroadcastHashJoin" not in held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], closure._cut
    monkeypatch.setattr(closure, "_cut", lambda df, _="": rounds.append(1) or cut(df))
    n = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 20), (30, 31), (50, 45)], "src int, dst int")
    expected, after = {}, {}
    for a, b in edges.collect():
        after.setdefault(a, set()).add(b)
    for start in range(n + 1):
        front, depth = after.get(start, set()), 1
        while front:
            new = {x for x in front if (start, x) not in expected}
            expected |= {(start, x): depth for x in new}
            front, depth = {y for x in new for y in after.get(x, ())}, depth + 1
    assert {(r.src, r.dst): r.depth for r in closure.transitive_closure(edges).collect()} == expected
    assert len(rounds) < 25
    assert {(r.src, r.dst): r.depth for r in closure.transitive_closure(edges, 21).collect()} == {k: d for k, d in expected.items() if d <= 21}


def test_texts_of_one_split_are_parsed_by_all_tasks(spark):
    docs = spark.range(40).coalesce(1).selectExpr("id AS doc_id", "'P' AS project", "concat(id, '.cs') AS file_path", "concat('class A', id, ' { void Go() { } }') AS text", "id AS doc_ord")
    for parsed in (csharp.rule_nodes, csharp.pragmas, csharp_tree.syntax_nodes, csharp_tree.declared_symbols, csharp_tree.inherits, csharp_flow.data_flow_facts, csharp_flow.control_flow_facts):
        assert parsed(docs).rdd.getNumPartitions() >= 4
    assert csharp_tree.syntax_nodes(docs).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("columns", [("src", "dst", "ord", "weight"), ("src", "dst", "weight")])
def test_communities_go_round_in_numbers_alone(spark, monkeypatch, columns):
    """Strings and structs were sorted in each pass."""
    rounds, store = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(dict(df.dtypes)) or store(df))
    pick = random.Random(3)
    pairs = [(f"n{pick.randrange(40)}", f"n{pick.randrange(40)}", pick.randrange(9) if "ord" in columns else 0, pick.randrange(1, 4)) for _ in range(150)]
    found = graph.communities_exact(spark.createDataFrame(pairs, "src string, dst string, ord int, weight int").select(*columns))
    assert {r.id: r.label for r in found.collect()} == propagated(pairs, 20)
    passes = [r for r in rounds if "other" in r or "label" in r]
    assert len(passes) > 3 and all(kind in ("bigint", "boolean") for r in passes for kind in r.values())


def test_a_name_has_few_keys_in_the_index(spark, tmp_path):
    """Names of 18 characters had 170 keys for near ones alone, all made by one task."""
    names = [f"Customer#{i:09d}" for i in range(300)]
    index = NameIndex.create(spark.createDataFrame([(n,) for n in names], "name string"), f"{tmp_path}/names", buckets=4)
    assert index._rows().count() <= 25 * len(names)
    assert {r.name for r in index.near("customer#00000011").collect()} >= {"Customer#000000011", "Customer#000000110"}


class _Calls:
    """A state that counts what it is asked."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        state, calls = self, lambda: setattr(self, "calls", self.calls + 1)

        class Value:
            def exists(self):
                calls()
                return name in state.values

            def get(self):
                calls()
                return state.values.get(name)

            def update(self, value):
                calls()
                state.values[name] = value

            def clear(self):
                calls()
                state.values.pop(name, None)

        return Value()

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_a_path_of_a_batch_asks_the_state_little():
    """Each access is a round trip: there were nine of them, and a frame even where nothing settled."""
    state, settle = _Calls(), Settle(10_000)
    settle.init(state)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["text", "at", "seq"])])
    assert list(settle.handleInputRows(("p",), batch(("b", 5_000, 2), ("a", 1_000, 1)), None)) == []
    state.calls = 0
    (out,) = settle.handleInputRows(("p",), batch(("c", 30_000, 3), ("b", 5_000, 2)), None)
    assert out.values.tolist() == [["p", "b", 5_000, 2]] and state.calls <= 4 and state.timers == {40}
    (last,) = settle.handleExpiredTimer(("p",), None, None)
    assert last.values.tolist() == [["p", "c", 30_000, 3]]
    assert list(settle.handleInputRows(("p",), batch(("c", 30_000, 3)), None)) == []
