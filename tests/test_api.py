"""Every tool of the surface on one small code base."""

import inspect as py

import pytest

from factgraph.api import CodeGraph
from factgraph.schema import CONTRACTS, FactSet, Workspace
from tests.conftest import rows
from tests.test_operators import symbols, tree

TOOLS = """find_symbol find_references find_implementations find_callers find_overrides get_public_api get_symbol_detail get_type_hierarchy
get_dependency_graph get_project_graph get_diagnostics get_test_coverage_map detect_antipatterns detect_circular_dependencies find_dead_code
get_complexity_metrics analyze_data_flow analyze_control_flow detect_duplicates resolve_external_source get_communities find_god_nodes
find_surprising_dependencies find_isolated_symbols analyze_method get_type_overview get_file_overview find_symbols_batch get_public_api_batch
get_symbol_detail_batch get_module_depends_on validate_granit_conventions list_solutions switch_solution""".split()


@pytest.fixture(scope="module")
def facts(spark):
    s = symbols(
        spark,
        {"name": "IShop", "type_kind": "interface", "namespace": "A.Core", "file": "/src/a.cs", "line": 1, "accessibility": "Public"},
        {"name": "Shop", "namespace": "A.Core", "file": "/src/a.cs", "line": 3},
        {"name": "Cart", "namespace": "B.Web.Ui", "project": "Q", "file": "/src/b.cs", "line": 1},
        {"name": "Run", "display": "Shop.Run", "kind": "Method", "container": "Shop", "container_name": "Shop", "namespace": "A.Core", "file": "/src/a.cs", "line": 5, "return_type": "Task"},
        {"name": "Old", "namespace": "A.Core", "file": "/src/a.cs", "line": 9},
        {"name": "ShopTests", "project": "P.Tests", "namespace": "T", "file": "/t.cs", "line": 1},
        {"name": "AModule", "namespace": "A.Core", "file": "/src/a.cs", "line": 20},
        {"name": "BModule", "namespace": "A.Core", "file": "/src/a.cs", "line": 30},
    )
    make = spark.createDataFrame
    return FactSet(spark, {
        "symbols": s,
        "refs": make([("Shop", "/src/b.cs", 2, "ObjectCreationExpression", None, " new Shop() "), ("Shop.Run", "/src/b.cs", 3, "MemberAccessExpression", "InvocationExpression", "x"), *[("Cart", "/src/a.cs", i, "Block", None, "c") for i in range(9)]], "symbol string, file string, line int, parent_kind string, grandparent_kind string, context string"),
        "inherits": make([("Shop", "IShop", "interface", 0)], "child string, parent string, rel string, ord int"),
        "overrides": make([("Sub.Run", "Shop.Run")], "member string, base_member string"),
        "calls": make([("Cart.Go", "Shop.Run", 0), ("Shop.Run", "Db.Save", 0)], "caller string, callee string, ord int"),
        "projects": make([("P", "/p.csproj", "net9", 0), ("Q", "/q.csproj", "net9", 1)], "project string, file_path string, target_framework string, ord int"),
        "project_refs": make([("P", "Q", 0), ("Q", "P", 0)], "src string, dst string, ord int"),
        "type_refs": make([("Cart", "Shop", "field", 0), ("Shop", "IShop", "interface", 1)], "src string, dst string, via string, ord int"),
        "diagnostics": make([("P", "/src/a.cs", 3, "CS1", "Error")], "project string, file string, line int, id string, severity string"),
        "documents": make([(1, "P", "/src/a.cs", "class ShopDto { async void M() { var t = DateTime.Now; } }", 0)], "doc_id long, project string, file_path string, text string, doc_ord int"),
        "syntax_nodes": tree(spark, ("Block", ("IfStatement", "IdentifierName", ("Block", "ReturnStatement"))), "Shop.Run"),
        "flow": make([("Shop.Run", "x", "declared"), ("Shop.Run", "y", "read")], "method string, variable string, role string"),
        "flow_edges": make([("Shop.Run", 0, 1, "return")], "method string, src int, dst int, kind string"),
        "attributes": make([("AModule", "DependsOn", "TypeOfExpression", "BModule", 0)], "owner string, name string, arg_kind string, arg_text string, pos int"),
        "solutions": make([("/x.sln", "x.sln", 0, True)], "path string, name string, depth int, is_active boolean"),
    })


@pytest.fixture(scope="module")
def code(facts):
    return CodeGraph(facts, env={})


def test_the_surface_is_whole():
    assert len(TOOLS) == 34 and all(callable(getattr(CodeGraph, t)) for t in TOOLS)


CASES = [
    ("find_symbol", ("*shop*",), "display", ["IShop", "Shop", "ShopTests"]),
    ("find_references", ("Shop",), "kind", ["instantiation"]),
    ("find_implementations", ("IShop",), "display", ["Shop"]),
    ("find_callers", ("Run",), "caller", ["Cart.Go"]),
    ("find_overrides", ("run", "shop"), "display", ["Sub.Run"]),
    ("get_public_api", ("Shop",), "name", []),
    ("get_symbol_detail", ("Run",), "return_type", ["Task"]),
    ("get_type_hierarchy", ("Shop",), "display", ["IShop"]),
    ("get_dependency_graph", ("Run",), "node", ["Db.Save", "Shop.Run"]),
    ("get_project_graph", ("p",), "project", ["P"]),
    ("get_diagnostics", (), "id", ["CS1"]),
    ("get_test_coverage_map", ("P",), "status", ["covered", "uncovered", "uncovered", "uncovered", "uncovered"]),
    ("detect_antipatterns", (), "id", ["AP001", "AP004", "GR-DTO"]),
    ("detect_circular_dependencies", (), "n", [2]),
    ("find_dead_code", ("solution", None, "types"), "display", ["AModule", "BModule", "IShop", "Old", "ShopTests"]),
    ("get_complexity_metrics", ("Run",), "cyclomatic", [2]),
    ("analyze_data_flow", ("Run",), "role", ["declared", "read"]),
    ("analyze_control_flow", ("Run",), "returns", [1]),
    ("detect_duplicates", (), "n", []),
    ("resolve_external_source", ("Shop",), "source", ["sourcelink"]),
    ("get_communities", (), "cohesion", [1.0]),
    ("find_god_nodes", (None, "class", 1.0), "display", ["Cart"]),
    ("find_surprising_dependencies", (), "score", [3]),
    ("find_isolated_symbols", (), "display", ["AModule", "BModule", "Old", "ShopTests"]),
    ("find_symbols_batch", ("Shop,none",), "query", ["Shop", "none"]),
    ("get_public_api_batch", ("Shop,none",), "type", [None, "Shop"]),
    ("get_symbol_detail_batch", ("Shop,none",), "display", [None, "Shop"]),
    ("get_module_depends_on", ("A",), "node", ["AModule", "BModule"]),
    ("validate_granit_conventions", (None, None, "naming"), "id", ["GR-DTO"]),
    ("list_solutions", (), "name", ["x.sln"]),
]


@pytest.mark.parametrize("tool, args, column, expected", CASES, ids=[c[0] for c in CASES])
def test_tool(code, tool, args, column, expected):
    assert [r[0] for r in rows(getattr(code, tool)(*args), column)] == sorted(expected, key=lambda v: repr((v,)))


def test_compound_tools(code):
    assert {k: v.count() for k, v in code.analyze_method("Run").items()} == {"detail": 1, "callers": 1, "call_graph": 2, "complexity": 1}
    assert code.get_type_overview("IShop")["implementations"].count() == 1
    assert code.get_file_overview("a.cs")["types"].count() == 5
    assert {k: v.count() for k, v in code.analyze_method("none").items()} == {"detail": 0, "callers": 0, "call_graph": 0, "complexity": 0}


def test_switching(facts, spark):
    code = CodeGraph(workspace=Workspace(lambda p: facts, ["/a.sln", "/b.sln"], "/a.sln"), env={})
    code.switch_solution("/B.sln")
    assert rows(code.list_solutions(), "path", "is_active") == [("/a.sln", False), ("/b.sln", True)]
    with pytest.raises(ValueError):
        CodeGraph(facts, env={}).switch_solution("/a.sln")


def test_a_cap_holds_for_all_answers(facts):
    assert CodeGraph(facts, env={"FACTGRAPH_MAX_RESULTS": "2"}).find_symbol("*").count() == 2
    assert CodeGraph(facts, env={"FACTGRAPH_MAX_RESULTS": "none"}).find_symbol("*").count() == 8


def test_defaults(code):
    default = lambda tool, name: py.signature(getattr(code, tool)).parameters[name].default
    assert [default("find_god_nodes", "max_results"), default("get_communities", "max_results"), default("find_dead_code", "max_results"), default("detect_antipatterns", "max_results")] == [20, 30, 50, 100]


def test_facts_round_trip(facts, spark, tmp_path):
    facts.write(f"{tmp_path}/p", {"symbols": "project"})
    back = FactSet.read(spark, f"{tmp_path}/p", ("symbols", "calls"))
    assert back["symbols"].columns == facts["symbols"].columns and back["symbols"].count() == 8
    facts["calls"].write.json(f"{tmp_path}/j/calls")
    assert rows(FactSet.read(spark, f"{tmp_path}/j", ("calls",), "json")["calls"]) == rows(facts["calls"])
    assert len(back) == len(CONTRACTS)


def test_a_table_that_nobody_made_is_an_error(spark):
    """Empty answers look like clean code; an empty table that was given is an answer."""
    code = CodeGraph(FactSet(spark, {"symbols": symbols(spark, {"name": "A"})}), env={})
    for ask in (code.get_communities, code.find_surprising_dependencies, code.find_isolated_symbols, code.find_dead_code, lambda: code.find_callers("A"), lambda: code.find_overrides("A"), lambda: code.detect_circular_dependencies("types")):
        with pytest.raises(ValueError, match="no fact table"):
            ask()


def test_tables_are_made_when_asked_for(spark):
    asked = []

    def make():
        asked.append(1)
        return symbols(spark, {"name": "A"})

    facts = FactSet(spark, {"symbols": make, "refs": lambda: 1 / 0})
    assert not asked and facts["symbols"].count() == 1 and facts["symbols"].count() == 1 and asked == [1]
    facts.cached("symbols").release()
    with pytest.raises(ValueError):
        facts.require("refs", "calls")
