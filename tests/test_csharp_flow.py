import pytest

from factgraph.api import CodeGraph
from factgraph.operators import metrics
from factgraph.sources import csharp_flow as cf
from factgraph.sources.csharp_tree import facts_from_texts
from tests.conftest import rows

#: body of M(int a, ref int r, out int o); reachable returns and throws, whether the end is reached, roles
CASES = [
    ("", 0, 0, True, {}),
    ("return a;", 1, 0, False, {"read": "a", "flows_in": "a"}),
    ("return 1; r = 2;", 1, 0, False, {"written": "r", "flows_out": "r"}),
    ("if (a > 0) { return 1; } return 2;", 2, 0, False, {"read": "a", "flows_in": "a"}),
    ("if (a > 0) { o = 1; } else { o = 2; } r++;", 0, 0, True, {"read": "a r", "written": "o r", "flows_in": "a r", "flows_out": "r o", "always_assigned": "r o"}),
    ("if (a > 0) o = 1; else throw new X(); a = 3; r = a;", 0, 1, True, {"read": "a", "written": "o a r", "flows_in": "a", "flows_out": "r o", "always_assigned": "a r o"}),
    ("while (true) { if (a > 3) break; a++; } return a;", 1, 0, False, {"read": "a", "written": "a", "flows_in": "a"}),
    ("while (true) { a++; }", 0, 0, False, {"read": "a", "written": "a", "flows_in": "a"}),
    ("for (int i = 0; i < a; i++) { if (i == 2) continue; r += i; }", 0, 0, True, {"declared": "i", "read": "i a r", "written": "i r", "flows_in": "a r", "flows_out": "r", "always_assigned": "i"}),
    ("foreach (var x in xs) { Use(x); }", 0, 0, True, {"declared": "x", "read": "x", "written": "x"}),
    ("int y; Get(out y); Get2(out var z); return y + z;", 1, 0, False, {"declared": "y z", "read": "y z", "written": "y z", "always_assigned": "y z"}),
    ("var f = xs.Select(q => { return q + a; }); return f;", 1, 0, False, {"declared": "f q", "read": "q a f", "written": "f", "captured": "a", "flows_in": "a", "always_assigned": "f"}),
    ("try { o = 1; } catch (Exception e) { Log(e); throw; } finally { r = 2; }", 0, 1, True, {"declared": "e", "read": "e", "written": "o e r", "flows_out": "r o", "always_assigned": "r o"}),
    ("switch (a) { case 1: o = 1; break; case 2: return 2; default: throw new X(); }", 1, 1, True, {"read": "a", "written": "o", "flows_in": "a", "flows_out": "o"}),
    ("switch (a) { case 1: return 1; default: return 2; }", 2, 0, False, {"read": "a", "flows_in": "a"}),
    ("switch (a) { case 1: return 1; }", 1, 0, True, {"read": "a", "flows_in": "a"}),
    ("do { a--; } while (a > 0);", 0, 0, True, {"read": "a", "written": "a", "flows_in": "a", "always_assigned": "a"}),
    ("do { return 1; } while (a > 0);", 1, 0, False, {"read": "a", "flows_in": "a"}),
    ("if (x is Foo q) { Use(q); } int k; if (a > 1) { k = 1; }", 0, 0, True, {"declared": "q k", "read": "q a", "written": "q k", "flows_in": "a"}),
    ("bool b = a > 1 && Try(out r) || a < 0; this.a = 1; s.a++;", 0, 0, True, {"declared": "b", "read": "a", "written": "r b", "flows_in": "a", "flows_out": "r", "always_assigned": "b"}),
    ("int n = 0; Run(() => n++); using (var d = Open()) { return n; }", 1, 0, False, {"declared": "n d", "read": "n", "written": "n d", "captured": "n", "always_assigned": "n d"}),
    ("while (a > 0) { a = Next(); } yield break;", 1, 0, False, {"read": "a", "written": "a", "flows_in": "a"}),
    ("for (;;) { }", 0, 0, False, {}),
    ("int v = a > 0 ? r : 2; o ??= v;", 0, 0, True, {"declared": "v", "read": "a r v o", "written": "v o", "flows_in": "a r", "flows_out": "o", "always_assigned": "o v"}),
]


@pytest.fixture(scope="module")
def code(spark):
    texts = [(i, "P", f"{i}.cs", f"class C {{ public int M{i}(int a, ref int r, out int o) {{ {body} }} }}", i) for i, (body, *_) in enumerate(CASES)]
    return CodeGraph(facts_from_texts(spark.createDataFrame(texts, "doc_id long, project string, file_path string, text string, doc_ord long")), env={})


def test_data_flow(code):
    found = {}
    for r in metrics.data_flow(code.facts["flow"]).collect():
        found.setdefault(r.method, {})[r.role] = r.variables
    for i, (body, *_, roles) in enumerate(CASES):
        assert found.get(f"C.M{i}", {}) == {k: sorted(v.split()) for k, v in roles.items()}, body


def test_control_flow(code):
    found = {r.method: r for r in metrics.control_flow(code.facts["flow_edges"]).collect()}
    for i, (body, returns, throws, end, _) in enumerate(CASES):
        r = found[f"C.M{i}"]
        # a method without any jump or end in reach has no counts
        assert (r.returns or 0, (r.exits or 0) - (r.returns or 0), bool(r.end_reachable)) == (returns, throws, end), body
    assert found["C.M22"].reachable == 1


def test_questions_about_one_method(code):
    assert rows(code.analyze_data_flow("M1"), "role", "variables") == [("flows_in", ["a"]), ("read", ["a"])]
    assert rows(code.analyze_control_flow("M3"), "returns", "end_reachable") == [(2, False)]
    assert code.analyze_data_flow("Nothing").count() == code.analyze_control_flow("Nothing").count() == 0


def test_expression_bodies_and_broken_texts():
    flow = dict(cf.flows("class C { public int M(int a) => a + 1; }"))["C.M"]
    assert list(flow.roles()) == [("a", "read"), ("a", "flows_in")] and [k for *_, k in flow.edges] == ["return"]
    for text in (None, "", "class C { void M( { if", "class C { public void M() { for (", "class C { public void M() { switch (x) { case", "class C { public void M() { try { } catch", "class C { public void M() { x = => ; break; } }"):
        assert isinstance(list(cf.flows(text)), list)
