import pytest

from factgraph.operators import metrics, quality, resolve
from factgraph.sources import csharp_tree as ct
from tests.conftest import rows

#: body, cyclomatic, cognitive, nesting
CASES = [
    ("return 1;", 1, 0, 0),
    ("if (a) { b(); }", 2, 1, 1),
    ("if (a) b(); else c();", 2, 2, 0),
    ("if (a) { } else if (b) { } else { }", 3, 4, 1),
    ("if (a && b || c) { }", 4, 1, 1),
    ("for (int i = 0; i < n; i++) { while (x) { } }", 3, 3, 2),
    ("foreach (var x in xs) { if (x > 0) { y(); } }", 3, 3, 2),
    ("do { a(); } while (b);", 1, 1, 1),
    ("switch (x) { case 1: a(); break; case 2: case 3: b(); break; default: c(); break; }", 4, 1, 0),
    ("switch (o) { case Foo f when f.A: a(); break; case > 3: break; default: break; }", 3, 1, 0),
    ("try { a(); } catch (Exception e) { b(); } finally { c(); }", 2, 1, 1),
    ("var y = a ? b : c;", 2, 1, 0),
    ("var y = a ?? b ?? c;", 3, 0, 0),
    ("var y = x switch { 1 => a, 2 => b, _ => c };", 4, 1, 0),
    ("xs.Select(x => { if (x) { return 1; } return 2; });", 2, 2, 1),
    ("Run(() => a && b);", 2, 1, 0),
    ("if (a) { for (;;) { if (b) { if (c) { d(); } } } }", 5, 10, 4),
    ("lock (x) { using (var y = z()) { a(); } }", 1, 0, 2),
    ('var s = "if (a) { }"; // if (b) {}', 1, 0, 0),
    ("List<Dictionary<string, int>> x = new List<Dictionary<string, int>>(); x.Add(null);", 1, 0, 0),
    ("if (x is Foo { A: 1 } f && f.B) { }", 3, 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"namespace N.S;\npublic class C\n{{\n    public void M{i}(int a)\n    {{\n        {body}\n    }}\n}}" for i, (body, *_) in enumerate(CASES)]
    return spark.createDataFrame([(i, "P", f"/c{i}.cs", t, i) for i, t in enumerate(texts)], "doc_id long, project string, file_path string, text string, doc_ord long")


@pytest.fixture(scope="module")
def measured(docs):
    return {r.owner_symbol: r for r in metrics.complexity(ct.syntax_nodes(docs), ct.method_texts(docs)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_metrics_of_texts(measured, i):
    r = measured[f"N.S.C.M{i}"]
    assert (r.cyclomatic, r.cognitive, r.max_nesting) == CASES[i][1:], CASES[i][0]
    assert r.logical_loc == 3


def test_intervals_nest():
    found = ct.tree_rows("class C { public int M() { if (a(b, c => d)) { e.f(); } return g; } public int N() => x && y; }")
    by_id = {r[0]: r for r in found}
    for node, parent, pre, post, depth, *_ in found:
        assert pre <= post
        if parent >= 0:
            _, _, a, b, d, *_ = by_id[parent]
            assert a < pre and post <= b and depth == d + 1
    assert {r[8] for r in found} == {"C.M", "C.N"} and any(r[5] == "ArrowExpressionClause" for r in found)


def test_symbols(spark, docs):
    found = ct.declared_symbols(docs)
    assert rows(resolve.find_symbol(found, "M1?", "method"), "container_name", "line")[:1] == [("C", 4)] and resolve.find_symbol(found, "M1?").count() == 10
    assert rows(resolve.find_symbol(found, "C"), "display", "accessibility", "namespace") == [("N.S.C", "Public", "N.S")]
    refs = spark.createDataFrame([(f"N.S.C.M{i}",) for i in range(1, len(CASES))], "symbol string")
    assert rows(quality.dead_code(found, refs, kind="methods"), "display") == [("N.S.C.M0",)]


def test_duplicate_bodies(spark):
    text = "class {0} {{ void {1}() {{ }} public int A(int x) {{ var y = x + {2}; Call(y); Call(x); if (y > 1) {{ return 5; }} return y; }} }}"
    docs = spark.createDataFrame([(i, text.format(f"C{i}", "Z", i)) for i in range(2)], "doc_id long, text string")
    every = metrics.normalized_bodies(ct.syntax_nodes(docs))
    assert every.count() == 4  # a method needs no modifier
    bodies = every.filter("owner_symbol LIKE '%.A'")
    assert bodies.select("normalized").distinct().count() == 1 and {r.statements for r in bodies.collect()} == {6}


@pytest.mark.parametrize("text", [None, "", "class", "class C { void M( { if", "public void M() { ((((", "public int X() { a ? b }", "public void M() { switch (x) { case", "public void M() { x = y switch { ", "public void M() => ", "public void M() { new }"])
def test_broken_texts_end(text):
    assert isinstance(ct.tree_rows(text), list)


def test_facts_from_texts(spark):
    from factgraph.api import CodeGraph

    a = "namespace N;\npublic class Shop\n{\n    internal void Run()\n    {\n        Save();\n        this.Save();\n    }\n    internal void Save() { }\n    internal void Unused() { }\n}"
    b = "class Cart\n{\n    internal void Go(Shop s)\n    {\n        var x = new Shop();\n        s.Run();\n        Use(s.Run);\n    }\n}"
    docs = spark.createDataFrame([(1, "P", "/a.cs", a, 0), (2, "P", "/b.cs", b, 1)], "doc_id long, project string, file_path string, text string, doc_ord long")
    code = CodeGraph(ct.facts_from_texts(docs), env={})
    assert rows(code.find_callers("Run"), "caller", "calls") == [("Cart.Go", 1)]
    assert rows(code.find_callers("Save"), "caller", "calls") == [("N.Shop.Run", 2)]
    assert rows(code.find_references("Run"), "file", "line", "kind", "context") == [("/b.cs", 6, "invocation", "s.Run();"), ("/b.cs", 7, None, "Use(s.Run);")]
    assert rows(code.find_dead_code(kind="methods"), "display") == [("Cart.Go",), ("N.Shop.Unused",)]
    assert [r.node for r in code.get_dependency_graph("Go").orderBy("pos").collect()] == ["Cart.Go", "N.Shop.Run", "N.Shop.Save", "N.Shop.Save"]
    assert rows(code.get_complexity_metrics("Run"), "cyclomatic") == [(1,)]
