"""Dead and isolated symbols, duplicates, coverage by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators.resolve import first_by
from factgraph.sources.scratch import checkpointed, in_order

# --- fixed values ---------------------------------------------------------------------

#: Contracts that a framework activates at run time.
ACTIVATION_CONTRACTS = (
    "Microsoft.Extensions.Hosting.IHostedService", "Microsoft.Extensions.Hosting.BackgroundService",
    "Microsoft.AspNetCore.Mvc.ControllerBase", "Microsoft.AspNetCore.Mvc.RazorPages.PageModel", "Microsoft.AspNetCore.Components.ComponentBase",
)
#: Attributes of tests and benchmarks.
TEST_ATTRIBUTES = (
    "Fact", "Theory", "Test", "TestMethod", "TestCase", "TestFixture", "TestClass", "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown",
    "ClassInitialize", "ClassCleanup", "AssemblyInitialize", "AssemblyCleanup", "GlobalSetup", "GlobalCleanup", "Benchmark",
)
#: Methods that hosts call by name.
ENTRY_POINTS = ("Main", "ConfigureServices", "Configure", "CreateHostBuilder", "CreateWebHostBuilder")
#: Attributes of types that frameworks find by scanning.
CONTROLLER_ATTRIBUTES = ("ApiController", "Controller", "McpServerToolType")
ISOLATION_ATTRIBUTES = ("McpServerToolType", "ApiController", "Controller", "Serializable")
#: Methods that are never reported by themselves.
SKIPPED_METHODS = ("constructor", "propertyget", "propertyset", "eventadd", "eventremove")


def _plain_attributes(column: str = "attributes"):
    return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda a: F.replace(a, F.lit("Attribute"), F.lit("")))


def framework_activated(symbols: DataFrame, inherits: DataFrame, contracts: tuple[str, ...] | DataFrame = ACTIVATION_CONTRACTS) -> DataFrame:
    """display of types at or below a contract (names, or a table with id). The walk starts at the contracts and goes down."""
    from factgraph.operators.closure import reachable

    start = contracts.select("id") if isinstance(contracts, DataFrame) else symbols.sparkSession.createDataFrame([(c,) for c in contracts], "id string")
    below = reachable(inherits.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start)
    types = symbols.filter(F.lower("kind") == "type").select("display")
    return types.join(below.select(F.col("id").alias("display")), "display", "left_semi").distinct()


def in_scope(symbols: DataFrame, scope: str = "solution", path: str | None = None, strict: bool = False) -> DataFrame:
    """Symbols of a scope. `file` means the first project that holds the file; strict: the file itself."""
    if scope.lower() == "file":
        here = symbols.filter(tx.path_ends_with(F.col("file"), path or "")) if path else symbols.limit(0)
        if strict:
            return here
        owner = here.agg(F.min_by("project", "sym_ord").alias("_p"))
        return symbols.join(F.broadcast(owner), F.col("project") == F.col("_p")).drop("_p")
    if scope.lower() == "project":
        return symbols.filter(tx.equals_ignore_case(F.col("project"), path)) if path else symbols.limit(0)
    return symbols


def dead_code(
    symbols: DataFrame, refs: DataFrame, member_impl: DataFrame | None = None, activated: DataFrame | None = None, *, scope: str = "solution",
    path: str | None = None, kind: str = "all", most: int | None = 50, include_public: bool = False, include_entry_points: bool = False,
    project_filter: str | None = None, file_filter: str | None = None, strict: bool = False,
) -> DataFrame:
    """Symbols without any reference, by one anti join, after the cheap predicates: display, kind, file, line, project."""
    rows = in_scope(symbols, scope, path, strict)
    if project_filter:
        rows = rows.filter(F.exists(F.array(*[F.lit(p.lower()) for p in tx.comma_list(project_filter)]), lambda p: F.contains(F.lower("project"), p)))
    if file_filter:
        rows = rows.filter(F.exists(F.array(*[F.lit(p.replace("\\", "/").lower()) for p in tx.comma_list(file_filter)]), lambda p: F.contains(tx.normal_path(F.col("file")), p)))
    wanted = {"types": "type", "methods": "method", "properties": "property"}.get(kind.lower())
    if wanted:
        rows = rows.filter(F.lower("kind") == wanted)
    false = F.lit(False)
    skip = (F.lower("kind") == "method") & F.coalesce(F.lower("method_kind").isin(*SKIPPED_METHODS), false)
    skip = skip | (F.lower("kind").isin("method", "property") & F.coalesce(F.col("is_override"), false))
    if not include_public:
        skip = skip | F.coalesce((F.lower("accessibility") == "public") & (F.lower("container_accessibility") == "public"), false)
    if not include_entry_points:
        named = F.lower("kind") == "method"
        skip = skip | (named & F.col("name").isin(*ENTRY_POINTS)) | (named & F.arrays_overlap(_plain_attributes(), F.array(*map(F.lit, TEST_ATTRIBUTES))))
    rows = rows.filter(~skip & ~F.coalesce(F.col("is_implicit"), false) & ~tx.is_generated_path(F.col("file")))
    if not include_entry_points:
        controllers = symbols.filter((F.lower("kind") == "type") & F.arrays_overlap(_plain_attributes(), F.array(*map(F.lit, CONTROLLER_ATTRIBUTES)))).select("display").distinct()
        rows = rows.join(controllers, "display", "left_anti").join(controllers.select(F.col("display").alias("container")), "container", "left_anti")
        if activated is not None:
            rows = rows.join(activated.select("display"), "display", "left_anti")
    if member_impl is not None:
        rows = rows.join(member_impl.select(F.col("member").alias("display")).distinct(), "display", "left_anti")
    out = rows.join(refs.select(F.col("symbol").alias("display")), "display", "left_anti").select("display", F.lower("kind").alias("kind"), "file", "line", "project", "sym_ord")
    return (out if most is None else out.orderBy("sym_ord", "display").limit(most)).drop("sym_ord")


def isolated_symbols(symbols: DataFrame, type_refs: DataFrame, refs: DataFrame, *, include_public: bool = False, most: int | None = 50, project: str | None = None) -> DataFrame:
    """Types that refer to no type of the solution and that nothing refers to: display, kind, file, line, project."""
    types = symbols.filter(F.lower("kind") == "type")
    rows = types.filter(
        tx.contains_ignore_case(F.col("project"), project)
        & ~F.coalesce(F.col("is_implicit"), F.lit(False))
        & ~F.coalesce(F.lower("type_kind").isin("delegate", "enum"), F.lit(False))
        & ~F.arrays_overlap(_plain_attributes(), F.array(*map(F.lit, ISOLATION_ATTRIBUTES)))
        & ~tx.is_system_namespace(F.coalesce("namespace", F.lit("-")))
    )
    if not include_public:
        rows = rows.filter(F.coalesce(F.lower("accessibility") != "public", F.lit(True)))
    # only references to types of the solution tie a type to it
    tied = type_refs.join(types.select(F.col("display").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("display"))
    out = rows.join(tied, "display", "left_anti").join(refs.select(F.col("symbol").alias("display")), "display", "left_anti")
    out = out.select("display", F.lower("type_kind").alias("kind"), "file", "line", "project", "sym_ord")
    return (out if most is None else out.orderBy("sym_ord", "display").limit(most)).drop("sym_ord")


def duplicates(bodies: DataFrame, min_statements: int = 5, most: int | None = 20, project: str | None = None) -> DataFrame:
    """Members of groups of method bodies with one fingerprint: fingerprint, member, nth, statements, n, similarity.

    bodies: display, project, normalized, statements, ord. The first `most` groups in the
    order of their first members; statements are those of the first member, nth counts a
    group's members from 0. A row a member, so no group is gathered in a row; texts stay
    where they were read, and are read once: fingerprints are stored.
    """
    rows = bodies.filter((F.col("statements") >= min_statements) & tx.equals_ignore_case(F.col("project"), project))
    rows = checkpointed(rows.select(F.sha2("normalized", 256).alias("fingerprint"), "display", "statements", "ord"))
    groups = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("statements", F.struct("ord", "display")).alias("statements")).filter("n > 1")
    if most is not None:
        groups = groups.orderBy("first", "fingerprint").limit(most)
    # members are counted in one order of all, so that a group of any size is sorted by many tasks
    placed = in_order(rows.drop("statements").join(groups.select("fingerprint"), "fingerprint", "left_semi"), "_place", "fingerprint", "ord", "display")
    begins = placed.groupBy("fingerprint").agg(F.min("_place").alias("_begin"))
    return placed.join(groups.join(begins, "fingerprint"), "fingerprint").select(
        "fingerprint", F.col("display").alias("member"), (F.col("_place") - F.col("_begin")).cast("int").alias("nth"), "statements", "n", F.lit(1.0).alias("similarity")
    )


def test_coverage_map(symbols: DataFrame, *, project: str | None = None, most: int | None = 100) -> DataFrame:
    """Production types with the test type that their name leads to: type_name, test_name, test_file, status.

    Six endings are tried in order, ignoring case; the first test type scanned counts.
    """
    types = symbols.filter((F.lower("kind") == "type") & ~F.coalesce(F.lower("type_kind").isin("enum", "delegate"), F.lit(False)))
    tests = first_by(types.filter(tx.is_test_project(F.col("project"))).select(F.lower("name").alias("key"), F.col("file").alias("test_file"), "sym_ord"), ["key"], ["sym_ord"])
    rows = types.filter(~tx.is_test_project(F.col("project")) & tx.equals_ignore_case(F.col("project"), project)).select("display", F.col("name").alias("type_name"), "sym_ord")
    if most is not None:
        rows = rows.orderBy("sym_ord", "display").limit(most)
    asked = rows.select("display", "sym_ord", "type_name", F.posexplode(F.transform(F.array(*map(F.lit, tx.TEST_TYPE_SUFFIXES)), lambda s: F.concat("type_name", s))).alias("rank", "test_name"))
    hit = asked.join(tests.select("key", "test_file"), F.lower("test_name") == F.col("key"))
    best = hit.groupBy("display", "sym_ord").agg(F.min_by(F.struct("test_name", "test_file"), "rank").alias("m"))
    return rows.join(best, ["display", "sym_ord"], "left").select(
        "type_name", F.col("m.test_name").alias("test_name"), F.col("m.test_file").alias("test_file"), F.when(F.col("m").isNotNull(), "covered").otherwise("uncovered").alias("status")
    )


def coverage_totals(coverage: DataFrame, *by: str) -> DataFrame:
    """total, covered and uncovered of coverage rows (status), for each value of the columns `by`."""
    return coverage.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("status") == "uncovered").alias("uncovered"))
