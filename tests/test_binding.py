"""Names bound by scopes: what a use means, and what follows from declarations alone."""

import pytest

from factgraph.api import CodeGraph
from factgraph.operators import binding
from factgraph.sources import csharp_tree as ct
from tests.conftest import rows

TEXTS = {
    "/shop.cs": """namespace Shop.Core;
public interface IStore { void Save(Order o); string Name { get; } }
public abstract class Base : IStore
{
    protected Order last;
    public virtual void Save(Order o) { last = o; }
    public string Name => "base";
    protected void Log(string s) { }
    public virtual int Count(int a) { return a; }
}
public class Order { public Customer Owner { get; set; } void Touch() { } public Order Next() { return this; } }
public class Customer { public string City; public void Touch() { } }
""",
    "/impl.cs": """using Shop.Core;
namespace Shop.Sql;
class Store : Base
{
    Order Log;
    public override void Save(Order o) { base.Save(o); Log.Owner.Touch(); }
    public override int Count(int b) { return base.Count(b); }
    public int Count(string s) { return 1; }
    void Run(Customer c)
    {
        var o = new Order();
        o.Next().Next().Owner.Touch();
        c.Touch();
        { Order c2 = o; c2.Next(); }
        foreach (Order each in all) { each.Next(); }
        Helper.Touch();
        this.Save(o);
        unknown.Rare();
        unknown.Touch();
    }
}
class Deep : Store { public override void Save(Order o) { } }
static class Helper { internal static void Touch() { } internal void Rare() { } }
""",
    "/other.cs": """namespace Elsewhere;
class Order { void Next() { } }
class Uses { Order mine; Shop.Core.Order theirs; void Go(Order a) { mine.Next(); theirs.Next(); a.Next(); Action f = () => { var a2 = theirs; a2.Next(); }; items.Each(a => a.Next()); } }
""",
}


@pytest.fixture(scope="module")
def facts(spark):
    docs = spark.createDataFrame([(i, "P", f, t, i) for i, (f, t) in enumerate(TEXTS.items())], "doc_id long, project string, file_path string, text string, doc_ord long")
    return ct.facts_from_texts(docs)


def test_calls_keep_types_of_one_name_apart(facts):
    found = {}
    for r in facts["calls"].collect():
        found.setdefault(r.callee, []).append(r.caller)
    own, uses, core = "Shop.Sql.Store.", "Elsewhere.Uses.Go", "Shop.Core."
    assert {k: sorted(v) for k, v in found.items()} == {
        core + "Base.Save": [own + "Save"], core + "Base.Count": [own + "Count"], own + "Save": [own + "Run"],
        core + "Customer.Touch": [own + "Run", own + "Run", own + "Save"], core + "Order.Next": [uses, uses] + [own + "Run"] * 4,
        "Elsewhere.Order.Next": [uses, uses], "Shop.Sql.Helper.Touch": [own + "Run"], "Shop.Sql.Helper.Rare": [own + "Run"],
    }


def test_uses_of_members_and_types(facts):
    refs = {}
    for r in facts["refs"].collect():
        refs.setdefault(r.symbol, set()).add((r.file, r.line))
    assert refs["Shop.Core.Order.Owner"] == {("/impl.cs", 6), ("/impl.cs", 12)}  # a field hides what is inherited
    assert refs["Shop.Sql.Store.Log"] == {("/impl.cs", 6)} and "Shop.Core.Base.Log" not in refs
    assert refs["Shop.Core.Base.last"] == {("/shop.cs", 6)} and ("/impl.cs", 11) in refs["Shop.Core.Order"] and ("/impl.cs", 16) in refs["Shop.Sql.Helper"]


def test_structural_references(facts):
    found = {tuple(r) for r in facts["type_refs"].select("src", "dst", "via").distinct().collect()}
    c, s, e = "Shop.Core.", "Shop.Sql.", "Elsewhere."
    assert found == {
        (c + "IStore", c + "Order", "parameter"), (c + "Base", c + "IStore", "interface"), (c + "Base", c + "Order", "field"), (c + "Base", c + "Order", "parameter"),
        (c + "Order", c + "Customer", "property"), (c + "Order", c + "Order", "return"), (s + "Store", c + "Base", "base"), (s + "Store", c + "Order", "field"),
        (s + "Store", c + "Order", "parameter"), (s + "Store", c + "Customer", "parameter"), (s + "Deep", s + "Store", "base"), (s + "Deep", c + "Order", "parameter"),
        (e + "Uses", e + "Order", "field"), (e + "Uses", c + "Order", "field"), (e + "Uses", e + "Order", "parameter"),
    }


def test_overrides_and_implementations(facts):
    c, s = "Shop.Core.Base.", "Shop.Sql."
    assert rows(facts["overrides"]) == [
        (s + "Deep.Save", c + "Save"), (s + "Deep.Save", s + "Store.Save"), (s + "Store.Count", c + "Count"), (s + "Store.Save", c + "Save"),
    ]
    face = "Shop.Core.IStore."
    assert rows(facts["member_impl"]) == sorted([(c + "Name", face + "Name"), (c + "Save", face + "Save"), (s + "Deep.Save", face + "Save"), (s + "Store.Save", face + "Save")])


def test_tools_on_texts_alone(facts):
    code = CodeGraph(facts, env={})
    assert rows(code.find_overrides("Save", "Base"), "display") == [("Shop.Sql.Deep.Save",), ("Shop.Sql.Store.Save",)]
    assert rows(code.find_callers("Next", "Order"), "caller") == [("Elsewhere.Uses.Go",), ("Shop.Sql.Store.Run",)]
    dead = {r.display for r in code.find_dead_code(max_results=None, include_entry_points=True).collect()}
    assert "Shop.Core.Order.Touch" in dead and not dead & {"Shop.Core.Order", "Shop.Core.Customer", "Shop.Core.Base", "Shop.Core.IStore", "Shop.Core.Base.Save", "Shop.Sql.Store"}
    assert rows(code.find_isolated_symbols(include_public_types=True), "display") == []
    assert code.get_communities().count() == 1 and code.find_surprising_dependencies().count() > 0


def test_roots_of_chains(facts, spark):
    used = ct.usings(facts["documents"])
    found = binding.chain_roots(facts["syntax_nodes"], facts["symbols"], facts["inherits"], used, facts["documents"])
    at = facts["syntax_nodes"].filter("owner_symbol = 'Shop.Sql.Store.Run'").select("doc_id", "node_id", "line", "kind")
    by_line = {}
    for r in found.join(at, ["doc_id", "node_id"]).collect():
        by_line[r.line] = max(by_line.get(r.line, (0, "", "")), (r.steps, r.type or "", r.symbol or ""))
    c = "Shop.Core."
    # o.Next().Next().Owner.Touch() goes on through the local o to `new Order()`
    assert by_line[12] == (8, c + "Order", c + "Order") and by_line[13] == (2, c + "Customer", "") and by_line[16] == (2, "Shop.Sql.Helper", "Shop.Sql.Helper")
    assert by_line[17] == (2, "Shop.Sql.Store", "") and by_line[18] == (2, "", "")


def test_members_of_types():
    text = """class A<T> : B<T> where T : class
    {
        object made = new Thing(1);
        Dictionary<string, List<int>> map = new();
        private static readonly int x, y = 3;
        public (int, int) Pair { get; }
        int Plain(int a, ref string b, params object[] rest) { int local = F(a); return local; }
        public A(int c) { Init(c); }
        T Generic<U>(U u = default) where U : new() => new A().Plain(u);
        class Inner { void Go() { } int deep; }
        event Handler Changed;
    }
    interface I { void M(); int P { get; } }
    record R(int Id, string? Name = "n");
    struct Empty;
    class After { int z; }"""
    assert [(d, f["return_type"], f["accessibility"]) for d, f, *_ in ct.methods(text)] == [
        ("A.Plain", "int", "Private"), ("A.Generic", "T", "Private"), ("Inner.Go", "void", "Private"), ("I.M", "void", "Public"),
    ]
    assert [(d, f["kind"], f["return_type"]) for d, f in ct.values(text)] == [
        ("A.made", "Field", "object"), ("A.map", "Field", "Dictionary<string,List<int>>"), ("A.x", "Field", "int"), ("A.Changed", "Field", "Handler"), ("Inner.deep", "Field", "int"),
        ("I.P", "Property", "int"), ("R.Id", "Property", "int"), ("R.Name", "Property", "string?"), ("After.z", "Field", "int"),
    ]
    assert ct.named_type("ref int a = 5") == ("a", "int", "5") and ct.named_type("[X] List<int, B> b") == ("b", "List<int,B>", None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, project string, file_path string, text string, doc_ord long")
    odd = spark.createDataFrame([(1, "P", "/a.cs", None, 0), (2, None, None, "", None), (3, "P", "/b.cs", "class", 1)], none.schema)
    for docs in (none, odd):
        facts = ct.facts_from_texts(docs)
        assert [facts[n].count() for n in ("symbols", "refs", "calls", "type_refs", "overrides", "member_impl")] == [0] * 6
