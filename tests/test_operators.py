"""Hand-computed facts, one for each behaviour that is easy to get wrong."""

from math import sqrt

from pyspark.sql import functions as F

from factgraph.operators import closure, graph, inspect, metrics, navigate, quality, resolve, rules
from factgraph.schema import FactSet, Workspace, conform
from tests.conftest import rows


def symbols(spark, *given):
    base = {"kind": "Type", "type_kind": "class", "accessibility": "Internal", "namespace": "N", "project": "P"}
    fields = sorted({k for g in given for k in g} | set(base) | {"display", "name", "sym_ord"})
    data = [{**base, "display": g["name"], "sym_ord": i, **g} for i, g in enumerate(given)]
    types = {"sym_ord": "long", "is_record": "boolean", "is_override": "boolean", "line": "int", "attributes": "array<string>"}
    return conform(spark.createDataFrame([tuple(d.get(f) for f in fields) for d in data], ", ".join(f"{f} {types.get(f, 'string')}" for f in fields)), "symbols")


def edges(spark, text, weight=False):
    found = [(a, b, i) for i, (a, b) in enumerate(e.split(">") for e in text.split())]
    return spark.createDataFrame(found, "src string, dst string, ord long")


def calls(spark, text):
    return edges(spark, text).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "ord")


def test_god_nodes_boundary_is_kept(spark):
    s = symbols(spark, *[{"name": n} for n in "abc"])
    refs = spark.createDataFrame([("a",), ("b",), *[("c",)] * 4], "symbol string")
    found = graph.god_nodes(s, refs, threshold=sqrt(2), min_refs=1, most=None).collect()
    # counts 1, 1, 4: mean 2, population deviation sqrt 2, and 4 = 2 + sqrt 2 * sqrt 2
    assert [(r.display, r.refs, r.mean, round(r.stddev, 9)) for r in found] in ([("c", 4, 2.0, round(sqrt(2), 9))], [])
    found = graph.god_nodes(s, refs, threshold=1.0, min_refs=4, most=None)
    assert rows(found, "display") == [("c",)]


def test_god_nodes_leave_the_platform_out(spark):
    s = symbols(spark, {"name": "a"}, {"name": "s", "namespace": "System.IO"})
    refs = spark.createDataFrame([("s",)] * 9 + [("a",)] * 5, "symbol string")
    assert rows(graph.god_nodes(s, refs, threshold=0, most=None), "display") == [("a",)]


def test_upper_median(spark):
    values = spark.createDataFrame([(1,), (2,), (4,), (8,)], "v int")
    assert graph.upper_median(values, "v").first()[0] == 4
    assert graph.upper_median(values.limit(0), "v").first()[0] is None


def test_dependency_tree_expands_a_symbol_once(spark):
    tree = graph.dependency_tree(calls(spark, "M>A M>B A>C B>C C>D"), "M").orderBy("pos")
    assert [(r.node, r.depth) for r in tree.collect()] == [("M", 0), ("A", 1), ("C", 2), ("D", 3), ("B", 1), ("C", 2)]


def modules(spark, text):
    return edges(spark, text).select(F.col("src").alias("module"), F.lit("p").alias("project"), F.col("dst").alias("dep"), F.lit(0).alias("pos"))


def test_module_tree_is_local_to_paths(spark):
    tree = graph.module_tree(modules(spark, "M>A M>B A>C B>C C>D"), "M", depth=3)
    assert tree.count() == 7
    assert rows(tree.filter("node = 'D'"), "known") == [(False,), (False,)]


def test_module_cycle_ends_in_a_stub(spark):
    tree = graph.module_tree(modules(spark, "A>B B>A"), "A", depth=5).orderBy("depth")
    assert [(r.node, r.is_stub) for r in tree.collect()] == [("A", False), ("B", False), ("A", True)]
    assert rows(graph.module_tree(modules(spark, "A>B B>C"), "c", depth=5, direction="dependents"), "node") == []
    assert rows(graph.module_tree(modules(spark, "A>B B>C C>D"), "c", depth=5, direction="dependents"), "node") == [("A",), ("B",), ("C",)]


def test_module_names_are_tried_in_order(spark):
    m = spark.createDataFrame([("GranitXModule", "p"), ("XModule", "p"), ("x", "p")], "module string, project string")
    asked = spark.createDataFrame([("X",), ("x",), ("XMODULE",), ("Y",)], "name string")
    assert rows(graph.resolve_modules(asked, m)) == [("X", "XModule"), ("XMODULE", "XModule"), ("Y", None), ("x", "x")]


def test_back_edges_give_one_cycle(spark):
    assert rows(graph.back_edge_cycles(edges(spark, "A>B B>A")), "nodes") == [(["A", "B", "A"],)]
    # C is finished when B is met again: no second cycle
    assert rows(graph.back_edge_cycles(edges(spark, "A>B B>C C>A A>C")), "nodes") == [(["A", "B", "C", "A"],)]
    # what leads nowhere is dropped first and changes nothing
    assert rows(graph.back_edge_cycles(edges(spark, "X>B A>Z B>C C>A A>B Z>Y Y>W W>V V>U")), "nodes") == [(["B", "C", "A", "B"],)]
    # a repeated edge repeats its cycle
    assert graph.back_edge_cycles(edges(spark, "A>B B>A B>A")).count() == 2


def test_bounded_cycles(spark):
    assert rows(graph.bounded_cycles(edges(spark, "A>B B>A B>C C>A A>A"), 3), "nodes") == [(["A", "B", "A"],), (["A", "B", "C", "A"],)]


def test_closure_and_reachable_agree(spark):
    e = edges(spark, "a>b b>c c>a c>d x>y")
    pairs = {(r.src, r.dst): r.depth for r in closure.transitive_closure(e).collect()}
    assert pairs["a", "d"] == 3 and pairs["a", "a"] == 3 and ("a", "x") not in pairs
    start = spark.createDataFrame([("a",)], "id string")
    reach = {r.id: r.depth for r in closure.reachable(e, start).collect()}
    assert reach == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_closure_over_a_long_chain(spark):
    e = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(12)))
    assert closure.reachable(e, spark.createDataFrame([("n0",)], "id string")).count() == 13


def test_communities(spark):
    e = edges(spark, "a>b b>c a>c d>e e>f d>f c>d").withColumn("weight", F.when(F.col("src") == "c", 1).otherwise(5))
    labels = {r.id: r.label for r in graph.communities_exact(e).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"] and labels["d"] == labels["e"] == labels["f"]
    stats = graph.community_stats(graph.communities_exact(e), e)
    assert [round(r.cohesion, 4) for r in stats.collect()] == [round(6 / 7, 4)] * 2


def test_surprising_dependencies_name_their_reasons(spark):
    e = edges(spark, "A.B.C>X.Y A.B.D>X.Y A.B.E>X.Y A.B.C>A.B.D A.B.E>A.B.C")
    owners = spark.createDataFrame([("A.B.C", "p", 0), ("X.Y", "q", 1), ("X.Y", "p", 2)], "id string, project string, ord int")
    found = {(r.src, r.dst): (r.score, r.reasons) for r in graph.surprising_dependencies(e, owners).collect()}
    score, reasons = found["A.B.C", "X.Y"]
    assert score == 4 and [x.split(" (")[0] for x in reasons] == ["cross-assembly", "hub target", "distant namespaces"]


def test_interface_is_resolved_before_the_exact_class(spark):
    s = symbols(spark, {"name": "Foo"}, {"name": "IFoo", "type_kind": "interface"}, {"name": "Bar"})
    inherits = conform(spark.createDataFrame([("Bar", "IFoo", "interface"), ("Baz", "Foo", "base")], "child string, parent string, rel string"), "inherits")
    assert rows(navigate.find_implementations(s, inherits, "Foo"), "display") == [("Bar",)]


def test_fuzzy_search_stops_at_the_first_project_with_a_find(spark):
    s = symbols(spark, {"name": "Ordes", "project": "A"}, {"name": "Orders", "project": "B"}, {"name": "Other", "project": "A"})
    p = spark.createDataFrame([("A", 0), ("B", 1)], "project string, ord int")
    assert rows(resolve.fuzzy_search(s, "Orderz", projects=p), "display", "score") == [("Ordes", 5)]
    assert rows(resolve.fuzzy_search(s, "orders"), "display", "match_quality") == [("Orders", "exact")]
    assert resolve.fuzzy_search(s, "Zzzzzz").count() == 0


def test_first_of_a_display_string_wins(spark):
    s = symbols(spark, {"name": "A", "display": "N.A", "project": "Q", "sym_ord": 5}, {"name": "A", "display": "N.A", "project": "P", "sym_ord": 2})
    assert rows(resolve.find_symbol(s, "a"), "project") == [("P",)]


def test_disambiguation_tries_file_then_line(spark):
    s = symbols(spark, {"name": "A", "display": "1", "file": "/x/a.cs", "line": 3}, {"name": "A", "display": "2", "file": "/x/b.cs", "line": 9}, {"name": "A", "display": "3", "file": "/x/c.cs", "line": 7})
    assert rows(resolve.resolve(s, "A", file="B.cs", line=7), "display") == [("2",)]
    assert rows(resolve.resolve(s, "A", file="none.cs", line=7), "display") == [("3",)]
    assert rows(resolve.resolve(s, "A"), "display") == [("1",)]


def test_batches(spark):
    s = symbols(spark, {"name": "A"})
    totals = resolve.batch_totals(resolve.find_symbols_batch(s, "nope")).first()
    assert (totals.succeeded, totals.failed) == (1, 0)
    totals = resolve.batch_totals(resolve.public_api_batch(s, "A,nope")).first()
    assert (totals.total, totals.succeeded, totals.failed) == (2, 1, 1)


def test_dead_code(spark):
    s = symbols(
        spark,
        {"name": "Internal"}, {"name": "Member", "kind": "Method", "accessibility": "Public", "container": "Internal", "container_accessibility": "Internal"},
        {"name": "Open", "kind": "Method", "accessibility": "Public", "container_accessibility": "Public"}, {"name": "Main", "kind": "Method"},
        {"name": "T", "kind": "Method", "attributes": ["FactAttribute"]}, {"name": "Over", "kind": "Method", "is_override": True},
        {"name": "ctor", "kind": "Method", "method_kind": "Constructor"}, {"name": "Gen", "file": "/a/obj/x.cs"}, {"name": "Used"}, {"name": "Act"}, {"name": "TopPublic", "accessibility": "Public"},
    )
    refs = spark.createDataFrame([("Used",)], "symbol string")
    active = spark.createDataFrame([("Act",)], "display string")
    assert rows(quality.dead_code(s, refs, activated=active), "display") == [("Internal",), ("Member",), ("TopPublic",)]
    assert rows(quality.dead_code(s, refs, activated=active, kind="types"), "display") == [("Internal",), ("TopPublic",)]
    assert quality.dead_code(s, refs, include_public=True, include_entry_points=True).count() == 7


def test_framework_activation_is_transitive(spark):
    s = symbols(spark, {"name": "A"}, {"name": "B"}, {"name": "C"})
    i = conform(spark.createDataFrame([("A", "B"), ("B", "Microsoft.Extensions.Hosting.BackgroundService")], "child string, parent string"), "inherits")
    assert rows(quality.framework_activated(s, i)) == [("A",), ("B",)]


def test_isolated(spark):
    s = symbols(spark, {"name": "Alone"}, {"name": "E", "type_kind": "enum"}, {"name": "Pub", "accessibility": "Public"}, {"name": "Ext"}, {"name": "Tied"}, {"name": "Seen"}, {"name": "Ser", "attributes": ["SerializableAttribute"]})
    refs = spark.createDataFrame([("Seen",)], "symbol string")
    types = spark.createDataFrame([("Tied", "Seen"), ("Ext", "System.String")], "src string, dst string")
    assert rows(quality.isolated_symbols(s, types, refs), "display") == [("Alone",), ("Ext",)]


def test_coverage_prefers_earlier_endings(spark):
    s = symbols(spark, {"name": "A", "project": "P"}, {"name": "B", "project": "P"}, {"name": "ASpec", "project": "P.Tests", "file": "1"}, {"name": "atests", "project": "P.Tests", "file": "2"})
    assert rows(quality.test_coverage_map(s)) == [("A", "ATests", "2", "covered"), ("B", None, None, "uncovered")]


def test_truncate_then_sort(spark):
    m = spark.createDataFrame([("a", 1), ("b", 9), ("c", 5)], "owner_symbol string, cyclomatic int")
    s = symbols(spark, *[{"name": n, "kind": "Method", "container_name": "T"} for n in "abc"])
    assert [r.cyclomatic for r in metrics.complexity_metrics(m, s, "T", scope="type", most=2).collect()] == [9, 1]
    assert [r.cyclomatic for r in metrics.complexity_metrics(m, s, "T", scope="type", most=2, strict_topk=True).collect()] == [9, 5]


def tree(spark, spec, owner="m"):
    """Nodes from nested tuples (kind, children...)."""
    out, count = [], [0]

    def add(node, parent, depth):
        kind, *below = node if isinstance(node, tuple) else (node,)
        own, count[0] = count[0], count[0] + 1
        at = len(out)
        out.append(None)
        for b in below:
            add(b, own, depth + 1)
        out[at] = (1, own, parent, own, count[0] - 1, depth, kind, owner)

    add(spec, -1, 0)
    return spark.createDataFrame(out, "doc_id long, node_id int, parent_id int, pre int, post int, depth int, kind string, owner_symbol string")


def measured(spark, spec):
    r = metrics.complexity(tree(spark, spec)).first()
    return r.cyclomatic, r.cognitive, r.max_nesting


def test_complexity(spark):
    assert measured(spark, ("Block", "ExpressionStatement")) == (1, 0, 0)
    flat_chain = ("Block", ("IfStatement", "IdentifierName", ("Block",), ("ElseClause", ("IfStatement", "IdentifierName", ("Block",)))))
    assert measured(spark, flat_chain) == (3, 3, 1)
    both = ("Block", ("IfStatement", ("LogicalAndExpression", "IdentifierName", "IdentifierName"), ("Block",)))
    assert measured(spark, both) == (3, 1, 1)
    deep = ("Block", ("IfStatement", "IdentifierName", ("Block", ("ForStatement", ("Block", ("WhileStatement", "IdentifierName", ("Block",)))))))
    assert measured(spark, deep) == (4, 6, 3)
    other = ("Block", ("IfStatement", "IdentifierName", ("Block",), ("ElseClause", ("Block", ("IfStatement", "IdentifierName", ("Block",))))))
    assert measured(spark, other)[1] == 4
    lambdas = ("Block", ("SimpleLambdaExpression", ("Block", ("IfStatement", "IdentifierName", ("Block",)))))
    assert measured(spark, lambdas)[1] == 2


def test_fingerprints_mask_names(spark):
    n = metrics.normalized_bodies(tree(spark, ("Block", ("ExpressionStatement", ("InvocationExpression", ("IdentifierName", "Hidden"), "NumericLiteralExpression")), ("ReturnStatement", "PredefinedType")))).first()
    assert n.normalized == "Block ExpressionStatement InvocationExpression ID LIT ReturnStatement TYPE"
    assert n.statements == 2


def test_duplicates_come_in_the_order_of_their_first_member(spark):
    b = spark.createDataFrame([("d", "P", "y", 7, 3), ("a", "P", "x", 5, 0), ("c", "P", "x", 6, 2), ("b", "P", "y", 8, 1), ("e", "P", "z", 9, 4), ("f", "P", "w", 2, 5), ("g", "P", "w", 2, 6)], "display string, project string, normalized string, statements int, ord int")
    assert rows(quality.duplicates(b, most=5), "member", "nth", "statements", "n") == [("a", 0, 5, 2), ("b", 0, 8, 2), ("c", 1, 5, 2), ("d", 1, 8, 2)]
    assert rows(quality.duplicates(b, most=1), "member") == [("a",), ("c",)]


def test_pragmas_ignore_order(spark):
    p = spark.createDataFrame([(1, 9, "disable", "A"), (1, 2, "restore", "A"), (1, 3, "disable", "B"), (2, 1, "disable", ""), (3, 1, "disable", None), (3, 2, "restore", "")], "doc_id long, line int, action string, code string")
    assert rows(rules.pragma_without_restore(p), "doc_id", "code") == [(1, "B"), (2, "*")]


def test_module_order(spark):
    m = spark.createDataFrame([("a", "p", "B", 0), ("a", "p", "a", 1), ("b", "p", "a", 0), ("b", "p", "B", 1), ("c", "p", "GranitCoreModule", 0)], "module string, project string, dep string, pos int")
    # ordinal: capitals come first
    assert rows(rules.dependency_order(m)) == [("a", True), ("b", False), ("c", True)]
    assert rows(rules.module_violations(m), "module", "id") == [("b", "GR-DEPS-ORDER"), ("c", "GR-DEPS-CORE")]


def test_label_styles(spark):
    s = symbols(spark, {"name": "e", "kind": "Event", "container": "T", "accessibility": "Public", "return_type": "H"}, {"name": "N", "kind": "Type", "container": "T", "accessibility": "Public"}, {"name": "T"}, {"name": "g", "kind": "Method", "method_kind": "PropertyGet", "container": "T", "accessibility": "Public"})
    said = lambda style: rows(inspect.public_api(s, "t", style), "name", "kind", "return_type")
    assert said("single") == [("N", "class", None), ("e", "event", "H")]
    assert said("batch") == [("N", "namedtype", None), ("e", "event", None)]
    assert said("overview") == [("N", "type", None), ("e", "event", None)]


def test_hierarchy(spark):
    s = symbols(spark, {"name": "C"}, {"name": "B"}, {"name": "A"}, {"name": "I", "type_kind": "interface"})
    i = conform(spark.createDataFrame([("C", "B", "base"), ("B", "object", "base"), ("A", "C", "base"), ("B", "I", "interface")], "child string, parent string, rel string"), "inherits")
    assert rows(navigate.type_hierarchy(s, i, "C")) == [("A", "derived", 1), ("B", "base", 1), ("I", "interface", 2)]


def test_diagnostics_of_a_file_count_for_its_first_project(spark):
    d = spark.createDataFrame([("B", "/a.cs", "Error", "X1"), ("A", "/a.cs", "Error", "X1"), ("A", "/a.cs", "Info", "X2"), ("A", "/a.cs", "Error", "XFadeOut")], "project string, file string, severity string, id string").withColumn("source", F.lit("compiler"))
    assert rows(inspect.diagnostics(d, "file", "A.cs"), "project", "id") == [("A", "X1")]


def test_control_flow(spark):
    e = spark.createDataFrame([("m", 0, 1, "goto"), ("m", 1, 2, "return"), ("m", 5, 6, "return"), ("n", 0, 1, "end")], "method string, src int, dst int, kind string")
    assert rows(metrics.control_flow(e), "method", "reachable", "returns", "end_reachable") == [("m", 3, 1, False), ("n", 2, 0, True)]


def test_workspace_keeps_its_facts_when_a_load_fails(spark):
    def load(path):
        if "bad" in path:
            raise OSError(path)
        return FactSet(spark)

    w = Workspace(load, ["/a.sln", "/bad.sln"], "/a.sln")
    for path, error in (("/bad.sln", OSError), ("/other.sln", ValueError)):
        try:
            w.switch_solution(path)
        except error:
            pass
        assert w.active == "/a.sln" and w.facts is not None
    assert rows(w.list_solutions(spark)) == [("/a.sln", "a.sln", True), ("/bad.sln", "bad.sln", False)]


def test_empty_facts_give_empty_answers(spark):
    f = FactSet(spark)
    assert graph.god_nodes(f["symbols"], f["refs"]).count() == 0
    assert quality.dead_code(f["symbols"], f["refs"]).count() == 0
    assert navigate.find_references(f["symbols"], f["refs"], "x").count() == 0
    assert graph.dependency_tree(f["calls"], "").count() == 0
    assert rows(graph.dependency_tree(f["calls"], "x")) == [(0, ["x"], "x", 0)]
    assert graph.back_edge_cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_method_body(spark):
    s = symbols(spark, {"name": "m", "kind": "Method", "file": "/a.cs"}, {"name": "n", "kind": "Method", "file": "/none.cs"})
    d = conform(spark.createDataFrame([(1, "Q", "/A.cs", 2), (1, "P", "/a.cs", 1)], "doc_id long, project string, file_path string, doc_ord long"), "documents")
    n = tree(spark, ("MethodDeclaration", "ParameterList", ("Block", "ReturnStatement")))
    assert rows(inspect.method_body(s, d, n, "M"), "project", "kind") == [("P", "Block"), ("P", "ReturnStatement")]
    assert inspect.method_body(s, d, n, "n").count() == 0


def test_circular_dependencies_filter_sources(spark):
    s = symbols(spark, {"name": "A", "project": "P"}, {"name": "B", "project": "Q"})
    t = spark.createDataFrame([("A", "B", "field", 0), ("B", "A", "base", 1), ("A", "A", "field", 2), ("B", "B", "return", 3)], "src string, dst string, via string, ord int")
    none = spark.createDataFrame([], "project string")
    assert rows(graph.circular_dependencies(none, t, t, s, scope="types"), "nodes") == [(["A", "B", "A"],)]
    assert graph.circular_dependencies(none, t, t, s, scope="types", project="p").count() == 0


def test_overviews(spark):
    from factgraph.operators import compound
    from factgraph.sources import csharp

    s = symbols(spark, {"name": "I", "type_kind": "interface", "file": "/a.cs", "line": 1}, {"name": "C", "file": "/a.cs", "line": 2}, {"name": "F", "kind": "Method", "container": "I", "accessibility": "Public", "file": "/a.cs"})
    facts = FactSet(spark, {
        "symbols": s,
        "inherits": spark.createDataFrame([("C", "I", "interface")], "child string, parent string, rel string"),
        "diagnostics": spark.createDataFrame([("P", "/a.cs", 1, "E1", "Error"), ("P", "/a.cs", 2, "I1", "Info")], "project string, file string, line int, id string, severity string"),
        "documents": spark.createDataFrame([(1, "P", "/a.cs", "await x.F();")], "doc_id long, project string, file_path string, text string"),
        "calls": spark.createDataFrame([("G", "F", 0), ("F", "H", 0)], "caller string, callee string, ord long"),
        "syntax_nodes": tree(spark, ("Block", ("IfStatement", "IdentifierName", ("Block",))), "F"),
    })
    t = compound.type_overview(facts, "I")
    assert [rows(t[k], c) for k, c in (("api", "name"), ("implementations", "display"), ("diagnostics", "id"), ("hierarchy", "relation"))] == [[("F",)], [("C",)], [("E1",)], [("derived",)]]
    f = compound.file_overview(facts, "A.cs", csharp.rule_nodes(facts["documents"]))
    assert rows(f["types"], "kind") == [("class",), ("interface",)] and rows(f["antipatterns"], "id") == [("GR-CFGAWAIT",)]
    m = compound.analyze_method(facts, "F")
    assert rows(m["callers"], "caller") == [("G",)] and rows(m["call_graph"], "node") == [("F",), ("H",)] and rows(m["complexity"], "cyclomatic") == [(2,)]


def test_components_are_tasks_of_their_own(spark):
    e = edges(spark, "a>b b>a x>y y>z z>x q>q")
    assert sorted(tuple(r.nodes) for r in graph.back_edge_cycles(e).collect()) == [("a", "b", "a"), ("q", "q"), ("x", "y", "z", "x")]
    found = {r.id: r.component for r in closure.connected_components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 99), (5, 5)], "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {99: 99, 100: 99}
    assert closure.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs_like_brute_force(spark):
    import random

    r = random.Random(4)
    names = {"".join(r.choice("abC") for _ in range(r.randint(0, 6))) for _ in range(120)} | {"red widget", "red widgte", "Red Widget"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a.lower(), 1):
            new = [i]
            for j, d in enumerate(b.lower(), 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("red widget",)], "name string")
    for most in (1, 2):
        expected = sorted((a, b, distance(a, b)) for a in names for b in names if a < b and 1 <= distance(a, b) <= most)
        assert rows(resolve.near_pairs(df, most=most), "a", "b", "distance") == expected


def test_a_cache_gives_up_what_was_used_least_lately(spark):
    from factgraph.schema import least_recently_used

    seen = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("d", 5)], "key string, seq long")
    assert [tuple(r) for r in least_recently_used(seen, 2).collect()] == [("b", 2), ("a", 3)]
    assert least_recently_used(seen, 9).count() == 0 and least_recently_used(seen.limit(0), 2).count() == 0
    assert [r.key for r in metrics.largest(seen.groupBy("key").count(), "count", 2, "key").collect()] == ["a", "b"]


def test_diagnostics_of_a_file_are_those_of_its_first_document(spark):
    d = spark.createDataFrame([("A", "x/a.cs", 1, "C1", "Error"), ("B", "y/a.cs", 2, "C2", "Error"), ("B", "z/a.cs", 3, "C3", "Error"), ("C", "x/a.cs", 4, "C4", "Info")], "project string, file string, line int, id string, severity string").withColumn("source", F.lit("compiler"))
    docs = spark.createDataFrame([(1, "C", "x/a.cs", 0), (2, "B", "y/a.cs", 1), (3, "B", "z/a.cs", 2), (4, "A", "x/a.cs", 3)], "doc_id long, project string, file_path string, doc_ord long")
    of = lambda path, **more: rows(inspect.diagnostics(d, "file", path, documents=docs, **more), "id")
    assert of("a.cs") == [] and of("a.cs", severity="info") == [("C4",)]  # the first document has nothing worse
    assert of("Y\\A.CS") == [("C2",)] and of("z/a.cs") == [("C3",)] and of("nowhere.cs") == []
    assert rows(inspect.diagnostics(d, "file", "x/a.cs"), "id") == [("C1",)]


def test_save_changes_goes_by_bases(spark):
    from factgraph.sources import csharp

    text = "class A { %s store; void B() { store.SaveChanges(); } }"
    docs = spark.createDataFrame([(i, "p", f"{i}.cs", text % t) for i, t in enumerate(("Shop", "Other", "DbContext", "Unknown", "Shop.Store?"))], "doc_id long, project string, file_path string, text string")
    inherits = spark.createDataFrame([("N.Shop", "M.Base", "base"), ("Base", "Microsoft.EntityFrameworkCore.DbContext", "base"), ("Other", "Thing", "base"), ("Store", "Base", None)], "child string, parent string, rel string")
    nodes = csharp.rule_nodes(docs)
    assert rows(rules.scan_rules(rules.with_receivers(nodes, inherits), ("GR-SYNC-EF",)), "file") == [("0.cs",), ("2.cs",), ("4.cs",)]
    assert rules.with_receivers(nodes, inherits).count() == nodes.count()


def test_conventions_of_categories_in_any_case(spark):
    from factgraph.sources import csharp

    docs = spark.createDataFrame([(1, "p", "a.cs", "class CreateRequest { } class ADto { object B() { return Guid.NewGuid(); } }")], "doc_id long, project string, file_path string, text string")
    ids = lambda check: rows(rules.validate_conventions(csharp.rule_nodes(docs), check=check), "id")
    assert ids("all") == [("GR-DTO",), ("GR-ENDPOINT-PREFIX",), ("GR-GUID",)] and ids("naming") == [("GR-DTO",), ("GR-ENDPOINT-PREFIX",)]
    assert ids("Naming") == [("GR-DTO",)] and ids("ALL") == ids("other") == [("GR-DTO",), ("GR-GUID",)] and ids("dependencies") == []


def test_module_checks_want_name_and_base_and_say_where(spark):
    from factgraph.sources import csharp

    s = symbols(spark, *[{"name": n, "display": n, "kind": "Type", "project": "p", "file": f"{n}.cs", "line": 3} for n in ("AModule", "BModule", "C")])
    inherits = spark.createDataFrame([("AModule", "GranitModule"), ("C", "GranitModule")], "child string, parent string")
    attributes = spark.createDataFrame([(n, "DependsOn", "TypeOfExpression", d, i) for n in ("AModule", "BModule", "C") for i, d in enumerate(("Z", "GranitCoreModule", "Z"))], "owner string, name string, arg_kind string, arg_text string, pos int")
    found = graph.module_facts(s, inherits, attributes)
    assert rows(found.select("module").distinct(), "module") == [("AModule",), ("BModule",), ("C",)]
    nodes = csharp.rule_nodes(spark.createDataFrame([], "project string, file_path string, text string"))
    hits = rules.validate_conventions(nodes, found, check="dependencies", file="amodule.cs")
    assert rows(hits, "project", "file", "line", "id") == [("p", "AModule.cs", 3, "GR-DEPS-CORE"), ("p", "AModule.cs", 3, "GR-DEPS-ORDER")]
    assert rules.validate_conventions(nodes, found, check="dependencies", file="bmodule.cs").count() == 0


def test_antipatterns_are_cut_in_the_order_of_scanning(spark):
    from factgraph.sources import csharp

    text = "class A { object B() { Thread.Sleep(1); return Guid.NewGuid(); } object C() { return Guid.NewGuid(); } }"
    docs = spark.createDataFrame([(1, "b", "z.cs", text, 0), (2, "a", "a.cs", text, 1)], "doc_id long, project string, file_path string, text string, doc_ord long")
    cut = lambda n: [(r.file, r.id) for r in rules.detect_antipatterns(csharp.rule_nodes(docs), most=n).collect()]
    assert cut(2) == [("z.cs", "GR-GUID")] * 2 and cut(4) == [("z.cs", "GR-GUID")] * 2 + [("z.cs", "GR-SLEEP"), ("a.cs", "GR-GUID")]


def test_facts_of_classes_from_texts(spark):
    from factgraph.sources import csharp_tree

    text = 'namespace N; [DependsOn(typeof(A), typeof(B<int>)), Other("x, y")] [Last(1)] public class M : Base<int>, IThing { } record R(int A) : Q(1); interface I : IA, JA { }'
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert rows(csharp_tree.inherits(docs), "child", "parent", "rel") == [("N.I", "IA", "interface"), ("N.I", "JA", "interface"), ("N.M", "Base<int>", "base"), ("N.M", "IThing", "interface"), ("N.R", "Q", "base")]
    found = rows(csharp_tree.attributes(docs), "owner", "name", "arg_kind", "arg_text", "pos")
    assert [x for x in found if x[1] == "DependsOn"] == [("N.M", "DependsOn", "TypeOfExpression", "A", 0), ("N.M", "DependsOn", "TypeOfExpression", "B<int>", 1)]
    assert [(x[1], x[2]) for x in found if x[1] != "DependsOn"] == [("Last", "Expression"), ("Other", "Expression")]
