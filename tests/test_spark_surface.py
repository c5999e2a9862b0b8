"""The data source for solution files, and table functions for SQL."""

import pytest

from factgraph.functions import table_functions
from factgraph.sources import discovery, solution_source

FILES = {
    "a/one.sln": '﻿\nMicrosoft Visual Studio Solution File\nProject("{X}") = "A", "src\\A\\A.csproj", "{Y}"\nEndProject\nProject("{X}") = "docs", "docs", "{Z}"\nEndProject\nProject("{X}") = "B", "B.CSPROJ", "{Y}"\nEndProject',
    "a/two.slnx": '<Solution><Folder Name="/x/"><Project Path="src/C/C.csproj" /></Folder><Project Path="d.fsproj" /></Solution>',
    "b/old-in-new.slnx": 'Project("{X}") = "E", "E.csproj", "{Y}"',
    "b/new-in-old.sln": '<Solution xmlns="urn:x"><Project Path="F.csproj"/></Solution>',
    "b/broken.slnx": "<Solution><Project",
    "b/other.sln": "hello",
    "b/empty.sln": "",
    "b/none.slnx": "<Solution />",
    "b/no.txt": 'Project("{X}") = "E", "E.csproj", "{Y}"',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("solutions")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "b" / "bytes.sln").write_bytes(b"\xff\xfe\x00Project")
    return str(root)


def test_solutions(spark, folder):
    solution_source.register(spark)
    found = spark.read.format("solution").option("tasks", 3).load(folder)
    rows = sorted((r.path.removeprefix(folder + "/"), r.form, r.ord, r.project, r.project_path) for r in found.filter("project IS NOT NULL").collect())
    assert rows == [
        ("a/one.sln", "classic", 0, "A", "src/A/A.csproj"), ("a/one.sln", "classic", 1, "B", "B.CSPROJ"), ("a/two.slnx", "xml", 0, "C", "src/C/C.csproj"),
        ("b/new-in-old.sln", "xml", 0, "F", "F.csproj"), ("b/old-in-new.slnx", "classic", 0, "E", "E.csproj"),
    ]
    broken = sorted(r.path.rpartition("/")[2] for r in found.filter("project IS NULL AND form IS NULL AND ord IS NULL").collect())
    assert broken == ["broken.slnx", "bytes.sln", "empty.sln", "other.sln"] and found.count() == 9 and found.rdd.getNumPartitions() == 3
    # where names tell the form, the reader of texts says the same
    texts = discovery.read_texts(spark, f"{folder}/a", "*.sln*")
    assert {(r.project, r.project_path) for r in discovery.solution_projects(texts).collect()} <= {(r[3], r[4]) for r in rows}


def test_filters_on_paths_open_nothing_else(spark, folder):
    reader = solution_source.SolutionReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, StringEndsWith

    left = list(reader.pushFilters([StringEndsWith(("path",), ".sln"), EqualTo(("form",), "xml")]))
    assert left == [EqualTo(("form",), "xml")] and sorted(p.rpartition("/")[2] for f in reader.partitions() for p in f.paths) == ["bytes.sln", "empty.sln", "new-in-old.sln", "one.sln", "other.sln"]
    found = spark.read.format("solution").load(folder).filter(f"path = '{folder}/a/two.slnx'")
    assert [r.project for r in found.collect()] == ["C"] and found.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="folder"):
        spark.read.format("solution").load().count()


def test_back_edges_of_any_type(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 1), (1, 2, 3, 2), (1, 3, 1, 3), (2, 9, 9, 0), (2, None, 9, 1)], "part int, src long, dst long, ord int").createOrReplaceTempView("some_edges")
    found = spark.sql("SELECT * FROM back_edges(TABLE(some_edges) PARTITION BY part ORDER BY ord)")
    assert found.schema.simpleString() == "struct<nodes:array<bigint>,n:int>"
    assert sorted((r.nodes, r.n) for r in found.collect()) == [([1, 2, 1], 2), ([1, 2, 3, 1], 3), ([9, 9], 1)]
    assert spark.sql("SELECT * FROM back_edges(TABLE(SELECT * FROM some_edges WHERE part > 5) PARTITION BY part ORDER BY ord)").count() == 0
    for bad in ("back_edges(1)", "back_edges(TABLE(SELECT 1 AS src, 'a' AS dst))", "back_edges(TABLE(SELECT 1 AS src))"):
        with pytest.raises(Exception, match="table|differ|no column"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_runs_and_intervals(spark):
    table_functions.register(spark)
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None), ("b", 4.0)], "k string, at double").createOrReplaceTempView("some_times")
    assert sorted(map(tuple, spark.sql("SELECT * FROM bursts(TABLE(some_times) PARTITION BY k ORDER BY (at), 5)").collect())) == [(1.0, 2.0, 2), (4.0, 4.0, 1), (9.0, 9.0, 1)]
    spark.createDataFrame([(0, 9), (1, 3), (2, 2), (4, 5), (10, 11)], "low int, high int").createOrReplaceTempView("some_spans")
    assert sorted(map(tuple, spark.sql("SELECT * FROM open_intervals(TABLE(some_spans) WITH SINGLE PARTITION ORDER BY low)").collect())) == [(0, 1), (1, 2), (2, 3), (4, 2), (10, 1)]
    assert set(table_functions.TABLE_FUNCTIONS) == {"back_edges", "bursts", "open_intervals"}
