import pytest
from pyspark.sql import functions as F

from factgraph.operators import rules
from factgraph.sources import csharp, discovery
from tests.conftest import rows

CASES = [
    ("AP001", "class A { public async void DoWork() { } }", True),
    ("AP001", "class A { public async void H(object s, MyEventHandler e) { } }", False),
    ("AP001", "class A { public async void H(object s, EventArgs e) { } }", True),
    ("AP001", "class A { public async Task DoWork() { } }", False),
    ("AP002", "var x = task.Result;", True),
    ("AP002", "task.Wait();", True),
    ("AP002", "task.Wait(100);", False),
    ("AP002", "task.GetAwaiter().GetResult();", True),
    ("AP002", "// task.Result", False),
    ("AP003", "var c = new HttpClient();", True),
    ("AP003", "HttpClient c = new();", True),
    ("AP003", 'var s = "new HttpClient()";', False),
    ("AP004", "var n = DateTime.Now;", True),
    ("AP004", "var n = clock.Now;", False),
    ("AP005", "try { } catch { }", True),
    ("AP005", "try { } catch (Exception e) { throw; }", True),
    ("AP005", "try { } catch (Exception e) when (e is X) { }", False),
    ("AP005", "try { } catch (IOException) { }", False),
    ("AP006", '_log.LogInformation($"x {y}");', True),
    ("AP006", '_log.LogInformation("x {Y}", y);', False),
    ("AP008", "class A { public async Task Run() { } }", True),
    ("AP008", "class A { public async Task Run(CancellationToken ct) { } }", False),
    ("AP009", "class C { DbSet<Order> Orders; void M() { Orders.Where(x => x.A).ToListAsync(); } }", True),
    ("AP009", "class C { DbSet<Order> Orders; void M() { Orders.AsNoTracking().ToListAsync(); } }", False),
    ("GR-GUID", "var g = Guid.NewGuid();", True),
    ("GR-SECRET", 'var p = "Password=abc";', True),
    ("GR-SECRET", 'var p = "hello";', False),
    ("GR-SYNC-EF", "_dbContext.SaveChanges();", True),
    ("GR-SYNC-EF", "_file.SaveChanges();", False),
    ("GR-BADREQ", "return TypedResults.BadRequest(x);", True),
    ("GR-REGEX", 'var r = new Regex("a");', True),
    ("GR-SLEEP", "Thread.Sleep(5);", True),
    ("GR-CONSOLE", 'Console.WriteLine("x");', True),
    ("GR-CONSOLE", "Console.ReadLine();", False),
    ("GR-CFGAWAIT", "await x.RunAsync();", True),
    ("GR-CFGAWAIT", "await x.RunAsync().ConfigureAwait(false);", False),
    ("GR-DTO", "public class OrderDto { }", True),
    ("GR-DTO", "public record Order(int Id);", False),
    ("GR-ENDPOINT-PREFIX", "public record CreateRequest(int Id);", True),
    ("GR-ENDPOINT-PREFIX", "public record CreateOrderRequest(int Id);", False),
    ("GR-CONVENTIONS-MISSING", "class C : DbContext { protected override void OnModelCreating(ModelBuilder b) { } }", True),
    ("GR-CONVENTIONS-MISSING", "class C : DbContext { protected override void OnModelCreating(ModelBuilder b) { b.ApplyGranitConventions(x, y); } }", False),
    ("GR-MANUAL-QUERYFILTER", "class C : DbContext { protected override void OnModelCreating(ModelBuilder b) { b.E().HasQueryFilter(x => x.A); } }", True),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, "P", str(i), text) for i, (_, text, _) in enumerate(CASES)], "doc_id long, project string, file_path string, text string")
    hits = rules.scan_rules(csharp.rule_nodes(docs)).select("file", "id").distinct().collect()
    return {(int(r.file), r.id) for r in hits}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rules(found, i):
    assert ((i, CASES[i][0]) in found) is CASES[i][2]


def test_test_projects_need_no_configure_await(spark):
    docs = spark.createDataFrame([(1, "A.Tests", "f", "await x.RunAsync();")], "doc_id long, project string, file_path string, text string")
    assert rules.scan_rules(csharp.rule_nodes(docs), ("GR-CFGAWAIT",)).count() == 0


def test_severity_and_pragmas(spark):
    text = "#pragma warning disable CS1, CS2\nclass A { }\n#pragma warning restore CS2\n#pragma warning disable\nawait x.F();\nvar g = Guid.NewGuid();"
    docs = spark.createDataFrame([(1, "P", "f.cs", text), (2, "P", "g.cs", None)], "doc_id long, project string, file_path string, text string")
    nodes, pragmas = csharp.rule_nodes(docs), csharp.pragmas(docs)
    assert rows(rules.detect_antipatterns(nodes, pragmas, docs), "line", "id") == [(1, "AP007"), (4, "AP007"), (6, "GR-GUID")]
    assert rows(rules.detect_antipatterns(nodes, pragmas, docs, severity="info"), "id") == [("AP007",), ("AP007",), ("GR-CFGAWAIT",), ("GR-GUID",)]
    assert rows(rules.validate_conventions(nodes, check="naming"), "id") == []
    assert rows(rules.by_category(rules.validate_conventions(nodes))) == [("async", 1), ("conventions", 1)]


def test_discovery_order_and_skips(spark):
    paths = ["/r/b.sln", "/r/A.slnx", "/r/x/c.sln", "/r/bin/d.sln", "/r/1/2/3/4/e.sln", "/r/1/2/3/f.sln", "/q/z.sln", "/r/n.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [(r.path, r.depth) for r in discovery.find_solutions(df, "/r").collect()] == [("/r/A.slnx", 0), ("/r/b.sln", 0), ("/r/x/c.sln", 1), ("/r/1/2/3/f.sln", 3)]
    assert discovery.best_solution(df, "/r").first().path == "/r/A.slnx"


def test_files(spark, tmp_path):
    (tmp_path / "src" / "A").mkdir(parents=True)
    (tmp_path / "x.sln").write_text('Project("{F}") = "A", "src\\A\\A.csproj", "{G}"\n')
    (tmp_path / "src" / "A" / "A.csproj").write_text('<Project><PropertyGroup><TargetFrameworks>net8;net9</TargetFrameworks></PropertyGroup><ItemGroup><ProjectReference Include="..\\B\\B.csproj" /></ItemGroup></Project>')
    (tmp_path / "src" / "A" / "B.csproj").write_text("broken")
    root = str(tmp_path)
    assert discovery.solution_path(spark, ["--solution", root], {}) == f"{root}/x.sln"
    assert discovery.solution_path(spark, [], {discovery.SOLUTION_ENV: f"{root}/x.sln"}) == f"{root}/x.sln"
    assert rows(discovery.solution_projects(discovery.read_texts(spark, root, "*.sln")), "project", "project_path") == [("A", "src/A/A.csproj")]
    assert rows(discovery.project_files(discovery.read_texts(spark, root, "*.csproj")), "project", "target_framework", "refs") == [("A", "net8;net9", ["B"]), ("B", None, None)]


def test_config_falls_back():
    assert discovery.number_from({"X": "7"}, "X", 3) == 7
    assert [discovery.number_from({"X": v}, "X", 3) for v in ("", "-1", "0", "abc")] == [3] * 4
    assert discovery.number_from({}, "X", 3) == 3


def test_sinks(spark):
    assert discovery.to_json(spark.createDataFrame([(1, None)], "a int, b string")).first().result == '{"a":1,"b":null}'
    assert "| 1 | x |" in discovery.markdown_report([{"a": 1, "b": "x"}], ["a", "b"], "T")
    lines = discovery.text_lines(spark.createDataFrame([("p", "a\r\nb")], "path string, text string"))
    assert rows(lines) == [("p", 1, "a"), ("p", 2, "b")]


def test_null_texts_are_empty(spark):
    docs = spark.createDataFrame([(1, None, None, None)], "doc_id long, project string, file_path string, text string")
    assert csharp.rule_nodes(docs).count() == 0 and csharp.pragmas(docs).count() == 0
    assert docs.select(F.col("text")).count() == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Fake

    from factgraph.sources import scratch

    none = Fake(isDefined=lambda: False)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        context = Fake(master=master, applicationId="a", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: none)))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_dir(Fake(conf=Fake(get=lambda *_: None), sparkContext=context))


def test_stored_tables_go_with_their_block(spark):
    import os

    from factgraph.sources import scratch

    with pytest.raises(KeyError), scratch.scratch(spark) as made:
        kept, path = scratch.stored(spark.range(3), "kept")
        other = scratch.stored(spark.range(4).selectExpr("id", "id % 2 AS k"), "other", "k")[1]
        assert sorted(os.listdir(other))[-2:] == ["k=0", "k=1"] and made == {path, other}
        made.discard(path)
        raise KeyError
    assert kept.count() == 3 and not os.path.exists(other)
    scratch.remove(spark, path)
    assert not os.path.exists(path)
