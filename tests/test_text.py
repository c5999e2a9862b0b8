import pytest
from pyspark.sql import functions as F

from factgraph.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, pattern, hit",
    [("OrderService", "orderservice", True), ("OrderService", "Order*", True), ("OrderService", "*vice", True), ("Order", "Orde?", True),
     ("Orders", "Orde?", False), ("a.b", "a?b", True), ("axb", "a.b", False), ("a+b", "a+*", True)],
)
def test_name_matches(spark, name, pattern, hit):
    assert one(spark, tx.name_matches(F.lit(name), pattern)) is hit


@pytest.mark.parametrize("a, b, d", [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "ABC", 0), ("Foo", "IFoo", 1)])
def test_edit_distance(spark, a, b, d):
    assert one(spark, tx.edit_distance(F.lit(a), F.lit(b))) == d


@pytest.mark.parametrize(
    "path, generated",
    [("/repo/src/Robot.cs", False), ("/repo/obj/x.cs", True), (r"C:\r\BIN\x.cs", True), ("/r/a.G.cs", True), ("/r/A.Designer.cs", True), (None, False), ("/r/objects/x.cs", False)],
)
def test_generated_path(spark, path, generated):
    assert one(spark, tx.is_generated_path(F.lit(path).cast("string"))) is generated


def test_generated_text(spark):
    assert one(spark, tx.is_generated_text(F.lit("// <Auto-Generated/>\nclass A {}"))) is True
    assert one(spark, tx.is_generated_text(F.lit("/* x */\n#nullable\n// <auto-generated>\n"))) is True
    assert one(spark, tx.is_generated_text(F.lit("class A {} // <auto-generated>"))) is False


@pytest.mark.parametrize("a, b, d", [("A.B.C", "A.B.D", 2), ("A", "A", 0), ("A.B", "A", 1), ("A", "B.C.D", 4)])
def test_namespace_distance(spark, a, b, d):
    assert one(spark, tx.namespace_distance(F.lit(a), F.lit(b))) == d


def test_system_namespaces_go_by_prefix(spark):
    assert one(spark, tx.is_system_namespace(F.lit("Systematic.X"))) is True
    assert one(spark, tx.is_system_namespace(F.lit("Granit.Core"))) is False
    assert one(spark, tx.is_system_namespace(F.lit(None).cast("string"))) is True


@pytest.mark.parametrize("project, hit", [("A.Tests", True), ("A.unittests", True), ("A.IntegrationTests", True), ("A.Testing", False), ("Tests", False)])
def test_test_projects(spark, project, hit):
    assert one(spark, tx.is_test_project(F.lit(project))) is hit


def test_common_prefix(spark):
    names = lambda *n: F.array(*map(F.lit, n))
    assert one(spark, tx.common_prefix(names("A.B.C", "A.B.D", "A.B"))) == "A.B"
    assert one(spark, tx.common_prefix(names("A.B", "C"))) is None
    assert one(spark, tx.common_prefix(names("A.B"))) == "A.B"


def test_severity_order(spark):
    assert one(spark, tx.at_least(F.lit("Error"), "warning")) is True
    assert one(spark, tx.at_least(F.lit("Info"), "warning")) is False
    assert one(spark, tx.at_least(F.lit("odd"), "info")) is True


def test_logical_lines(spark):
    assert one(spark, tx.logical_lines(F.lit("a\n\n  // b\n\t/* c\n d */\r\n"))) == 3


def test_reference_kind(spark):
    kind = lambda p, g=None: one(spark, tx.reference_kind(F.lit(p), F.lit(g).cast("string")))
    assert [kind("BaseList"), kind("ObjectCreationExpression"), kind("MemberAccessExpression", "InvocationExpression"), kind("MemberAccessExpression"), kind("Block")] == [
        "inheritance", "instantiation", "invocation", None, None,
    ]


def test_paths(spark):
    assert one(spark, tx.path_ends_with(F.lit(r"C:\Repo\A.cs"), "repo/a.CS")) is True
    assert one(spark, tx.path_ends_with_raw(F.lit(r"C:\Repo\A.cs"), "repo/a.cs")) is False
    assert tx.comma_list(" a, ,b,") == ["a", "b"]
