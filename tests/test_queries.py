"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.test_cycles import propagated

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(value):
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return repr(float(value))  # a column of flags with nulls may come as numbers
    if hasattr(value, "__float__"):
        return repr(float(value))
    return str(value)


def canonical(df):
    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


#: Held against a walk in Python instead of SQL.
WALKED = {"communities_parts"}


@pytest.mark.parametrize("name", [n for n in entry.plans.QUERIES if n not in WALKED])
def test_query(spark, db, name):
    found = entry.queries()[name](spark, FOLDER).toPandas()
    expected = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)


def test_communities_of_all_parts(spark, db):
    pairs = db.execute(f"WITH {entry.plans.PARTS} SELECT printf('%09d', src), printf('%09d', dst), 0, weight FROM e").fetchall()
    found = entry.queries()["communities_parts"](spark, FOLDER).collect()
    assert {r.id: r.label for r in found} == propagated(pairs, 20)


def test_whole_tables(spark, db):
    """Nothing is left out by an id: every nation is entered, every customer looked up."""
    count = lambda name: db.execute(f"SELECT count(*) FROM {name}").fetchone()[0]
    run = lambda name: entry.queries()[name](spark, FOLDER)
    flow = run("control_flow_reach").collect()
    assert len({r.method for r in flow}) == len(flow) == count("nation") and max(r.reachable for r in flow) > 1
    assert run("test_coverage_map").count() == count("customer")
    totals = run("coverage_totals").first()
    assert (totals.total, totals.covered) == (count("customer"), count("supplier")) and totals.uncovered > 0


def test_no_caps(spark, monkeypatch):
    nodes = [f"n{i}" for i in range(8)]
    chain = spark.createDataFrame([(a, b, 1) for a, b in zip(nodes, nodes[1:])], "src string, dst string, weight long")
    monkeypatch.setattr(entry.plans.ad, "nation_edges", lambda t: chain)
    assert entry.queries()["transitive_closure"](spark, FOLDER).count() == 7 * 8 // 2
    monkeypatch.setattr(entry.plans, "Tables", lambda spark, folder: type("T", (), {"events": events})())
    events = spark.range(60 * 19).selectExpr("id AS event_id", "id % 60 AS user_id", "'click' AS event_type")
    assert entry.queries()["complexity_metrics"](spark, FOLDER).count() == 60


def test_every_rule_is_hit_and_missed(spark):
    from factgraph.operators import rules

    wanted = {*rules.RULES, "AP007", "GR-DEPS-CORE", "GR-DEPS-ORDER"}
    assert {rule for _, rule in entry.plans.CASES if rule} == wanted and len(wanted) == 23
    assert {r.id for r in entry.queries()["every_rule"](spark, FOLDER).select("id").distinct().collect()} == wanted


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
