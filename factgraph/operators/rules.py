"""Rules over syntax facts: one scan, every rule a column.

`rule_nodes` (factgraph.sources.csharp makes them, any front end may) has a row for
each node that some rule looks at: project, file, line, kind, name, text, parent_kind,
modifiers array, type, params array (types), args array (kinds), bases array, body,
assembly, and, where a front end knows them, doc_ord and pos, the order of files and of
places in a file. bases of a call are those of its receiver's type, empty if that type
isn't known; name of an awaited expression is that of the method called last. A rule is a condition with a message; all conditions are evaluated in one pass
and the violations unnested, so the number of rules doesn't multiply scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx

# --- fixed values ---------------------------------------------------------------------

CLOCKS = (
    "DateTime.Now", "DateTime.UtcNow", "DateTimeOffset.Now", "DateTimeOffset.UtcNow",
    "System.DateTime.Now", "System.DateTime.UtcNow", "System.DateTimeOffset.Now", "System.DateTimeOffset.UtcNow",
)
LOG_METHODS = ("Log", "LogTrace", "LogDebug", "LogInformation", "LogWarning", "LogError", "LogCritical")
CONSOLE_CALLS = ("Console.Write", "Console.WriteLine", "System.Console.Write", "System.Console.WriteLine")
GUID_CALLS = ("Guid.NewGuid", "System.Guid.NewGuid")
SLEEP_CALLS = ("Thread.Sleep", "System.Threading.Thread.Sleep")
HTTP_TYPES = ("HttpClient", "System.Net.Http.HttpClient")
REGEX_TYPES = ("Regex", "System.Text.RegularExpressions.Regex")
TERMINAL_CALLS = (
    "ToListAsync", "ToArrayAsync", "FirstAsync", "FirstOrDefaultAsync", "SingleAsync", "SingleOrDefaultAsync", "CountAsync", "AnyAsync",
    "AllAsync", "ToList", "ToArray", "First", "FirstOrDefault", "Single", "SingleOrDefault",
)
CANCELLATION_TYPES = ("CancellationToken", "System.Threading.CancellationToken")
CONTEXT_TYPES = ("DbContext", "Microsoft.EntityFrameworkCore.DbContext")
ENDPOINT_VERBS = ("Create", "Update", "Delete", "Get", "List", "Search")
#: Of the secret rule only a description exists; these are its words.
SECRET = r"(?i)(password\s*=|pwd\s*=|api_?key|secret|connectionstring|bearer\s+[a-z0-9._\-]{8,}|token\s*[=:]\s*[\"'][a-z0-9_\-]{16,})"
#: Category of a rule id, for conventions.
CATEGORIES = {
    "GR-DTO": "naming", "GR-ENDPOINT-PREFIX": "naming", "GR-SECRET": "security", "GR-SYNC-EF": "efcore", "AP009": "efcore",
    "GR-CONVENTIONS-MISSING": "efcore", "GR-MANUAL-QUERYFILTER": "efcore", "GR-DEPS-CORE": "dependencies", "GR-DEPS-ORDER": "dependencies",
    "GR-CFGAWAIT": "async", "GR-GUID": "conventions", "GR-BADREQ": "conventions", "GR-REGEX": "conventions", "GR-SLEEP": "conventions", "GR-CONSOLE": "conventions",
}
#: Rules that belong to conventions, and those of them that `all` runs.
CONVENTION_RULES = ("GR-DTO", "GR-SECRET", "GR-SYNC-EF", "GR-CFGAWAIT", "GR-GUID", "GR-BADREQ", "GR-REGEX", "GR-SLEEP", "GR-CONSOLE")
STRUCTURAL_RULES = ("GR-ENDPOINT-PREFIX", "GR-CONVENTIONS-MISSING", "GR-MANUAL-QUERYFILTER", "GR-DEPS-CORE", "GR-DEPS-ORDER")
BY_CATEGORY = {
    "naming": ("GR-DTO", "GR-ENDPOINT-PREFIX"), "security": ("GR-SECRET",), "dependencies": ("GR-DEPS-CORE", "GR-DEPS-ORDER"),
    "efcore": ("GR-SYNC-EF", "AP009", "GR-CONVENTIONS-MISSING", "GR-MANUAL-QUERYFILTER"),
}


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    when: Callable[[], Column]
    message: Callable[[], Column]


RULES: dict[str, Rule] = {}


def rule(id: str, severity: str, message: str | Callable[[], Column]):
    """Registers a condition over rule_nodes under an id. New rules need nothing else."""

    def register(when: Callable[[], Column]) -> Callable[[], Column]:
        RULES[id] = Rule(id, severity, when, message if callable(message) else lambda: F.lit(message))
        return when

    return register


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _last(column: str = "text") -> Column:
    return F.substring_index(column, ".", -1)


def _has(array: str, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def _some(array: str, part: str) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.contains(x, F.lit(part))), F.lit(False))


@rule("AP001", "Error", lambda: F.concat(F.lit("async void method "), "name"))
def async_void() -> Column:
    return _is("MethodDeclaration") & _has("modifiers", "async") & (F.col("type") == "void") & ~_some("params", "EventHandler")


@rule("AP002", "Error", "a task is waited for synchronously")
def sync_over_async() -> Column:
    result = _is("MemberAccessExpression") & (_last() == "Result") & (F.coalesce("parent_kind", F.lit("")) != "InvocationExpression")
    wait = _is("InvocationExpression") & F.contains("text", F.lit(".")) & (_last() == "Wait") & (F.size("args") == 0)
    awaiter = _is("InvocationExpression") & F.col("text").rlike(r"\.\s*GetAwaiter\s*\(\s*\)\s*\.\s*GetResult$")
    return result | wait | awaiter


@rule("AP003", "Warning", "an HttpClient is made directly")
def http_client() -> Column:
    return _is("ObjectCreationExpression", "ImplicitObjectCreationExpression") & F.col("type").isin(*HTTP_TYPES)


@rule("AP004", "Warning", lambda: F.concat("text", F.lit(" reads the clock directly")))
def clock() -> Column:
    return _is("MemberAccessExpression") & F.col("text").isin(*CLOCKS)


@rule("AP005", "Warning", "everything is caught")
def broad_catch() -> Column:
    return _is("CatchClause") & (F.col("type").isNull() | F.col("type").isin("Exception", "System.Exception")) & ~_has("modifiers", "when")


@rule("AP006", "Warning", "an interpolated string is logged")
def log_interpolation() -> Column:
    return _is("InvocationExpression") & _last().isin(*LOG_METHODS) & _has("args", "InterpolatedStringExpression")


@rule("AP008", "Warning", lambda: F.concat(F.lit("public async method without a cancellation token: "), "name"))
def no_token() -> Column:
    return _is("MethodDeclaration") & _has("modifiers", "public") & _has("modifiers", "async") & ~(_has("params", CANCELLATION_TYPES[0]) | _has("params", CANCELLATION_TYPES[1]))


@rule("AP009", "Info", "a query is materialized with tracking")
def tracking() -> Column:
    rooted = F.coalesce(F.contains("type", F.lit("DbSet")) | F.contains("type", F.lit("IQueryable")), F.lit(False))
    return _is("InvocationExpression") & F.contains("text", F.lit(".")) & _last().isin(*TERMINAL_CALLS) & rooted & ~F.col("text").rlike(r"\.\s*AsNoTracking(WithIdentityResolution)?\b")


def _calls(*texts: str) -> Column:
    return _is("InvocationExpression") & F.col("text").isin(*texts)


@rule("GR-GUID", "Warning", "Guid.NewGuid")
def new_guid() -> Column:
    return _calls(*GUID_CALLS)


@rule("GR-SECRET", "Error", "a literal looks like a secret")
def secret() -> Column:
    return _is("StringLiteralExpression") & F.col("text").rlike(SECRET)


@rule("GR-SYNC-EF", "Warning", "SaveChanges is synchronous")
def sync_save() -> Column:
    by_name = F.lower(F.regexp_replace("text", r"\.\s*SaveChanges$", "")).rlike("context|db")
    by_type = _has("bases", CONTEXT_TYPES[0]) | _has("bases", CONTEXT_TYPES[1])
    own = F.coalesce(F.regexp_replace("type", r"\?$", "").isin(*CONTEXT_TYPES), F.lit(False))
    known = F.coalesce(F.size("bases") > 0, F.lit(False))  # else the receiver's name is all there is
    return _is("InvocationExpression") & F.contains("text", F.lit(".")) & (_last() == "SaveChanges") & (own | F.when(known, by_type).otherwise(by_name))


@rule("GR-BADREQ", "Warning", "BadRequest of results")
def bad_request() -> Column:
    return _is("InvocationExpression") & F.col("text").rlike(r"^(TypedResults|Results)\.BadRequest$")


@rule("GR-REGEX", "Warning", "a Regex is made at run time")
def new_regex() -> Column:
    return _is("ObjectCreationExpression", "ImplicitObjectCreationExpression") & F.col("type").isin(*REGEX_TYPES)


@rule("GR-SLEEP", "Warning", "Thread.Sleep")
def sleep() -> Column:
    return _calls(*SLEEP_CALLS)


@rule("GR-CONSOLE", "Warning", "Console output")
def console() -> Column:
    return _calls(*CONSOLE_CALLS)


@rule("GR-CFGAWAIT", "Info", "await without ConfigureAwait")
def configure_await() -> Column:
    assembly = F.lower("assembly")
    test = F.endswith(assembly, F.lit(".tests")) | F.endswith(assembly, F.lit(".test")) | F.contains(assembly, F.lit(".tests."))
    configured = F.coalesce(F.col("name") == "ConfigureAwait", F.lit(False)) | F.col("text").rlike(r"\.\s*ConfigureAwait\s*\((?:[^()]|\([^()]*\))*\)$")
    return _is("AwaitExpression") & ~F.coalesce(configured, F.lit(False)) & ~F.coalesce(test, F.lit(False))


@rule("GR-DTO", "Warning", lambda: F.concat("name", F.lit(" is named after a transfer object")))
def dto() -> Column:
    return _is("ClassDeclaration", "RecordDeclaration", "RecordStructDeclaration") & (F.endswith("name", F.lit("Dto")) | F.endswith("name", F.lit("DTO")))


@rule("GR-ENDPOINT-PREFIX", "Warning", lambda: F.concat("name", F.lit(" has no context in its name")))
def endpoint_prefix() -> Column:
    return _is("ClassDeclaration", "RecordDeclaration", "RecordStructDeclaration") & F.col("name").rlike(f"^({'|'.join(ENDPOINT_VERBS)})(Request|Response)$")


def _model_creating() -> Column:
    return _is("MethodDeclaration") & (F.col("name") == "OnModelCreating") & _some("bases", "DbContext")


@rule("GR-CONVENTIONS-MISSING", "Error", "OnModelCreating applies no conventions")
def conventions_missing() -> Column:
    return _model_creating() & ~F.contains(F.coalesce("body", F.lit("")), F.lit("ApplyGranitConventions"))


@rule("GR-MANUAL-QUERYFILTER", "Warning", "OnModelCreating sets a query filter itself")
def manual_filter() -> Column:
    return _model_creating() & F.contains(F.coalesce("body", F.lit("")), F.lit("HasQueryFilter"))


def scan_rules(nodes: DataFrame, ids: tuple[str, ...] | None = None, ordered: bool = False) -> DataFrame:
    """(project, file, line, id, severity, message) of all chosen rules, in one pass over the nodes.

    ordered: also doc_ord, rank and pos, the order in which rules run over files.
    """
    chosen = [RULES[i] for i in (ids or RULES) if i in RULES]
    hits = F.array(
        *[F.when(F.coalesce(r.when(), F.lit(False)), F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), r.message().alias("message"))) for r in chosen]
    )
    if not ordered:
        return nodes.select("project", "file", "line", F.inline(F.array_compact(hits)))
    place = [(F.col(c) if c in nodes.columns else F.lit(0)).cast("long").alias(c) for c in ("doc_ord", "pos")]
    found = nodes.select("project", "file", "line", *place, F.inline(F.array_compact(hits)))
    return found.select("project", "file", "line", "id", "severity", "message", "doc_ord", rank().alias("rank"), "pos")


def rank() -> Column:
    """The place of a rule among all: they run over a file one after another."""
    order = [*RULES, "AP007"]
    return F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(sorted(order)) for x in (r, i)]), F.col("id")).cast("long")


def with_receivers(nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """nodes whose SaveChanges calls have, in bases, what `inherits` says of the receiver's type.

    A type at or below DbContext, at any distance, has that base; another known type has
    `object`; of an unknown one nothing is said. Types are met by their simple names.
    """
    from factgraph.operators.closure import reachable

    simple = lambda c: F.substring_index(F.regexp_replace(c, r"<.*$|\?$", ""), ".", -1)
    edges = inherits.filter("rel IS NULL OR rel = 'base'").select(simple(F.col("parent")).alias("src"), simple(F.col("child")).alias("dst"))
    below = reachable(edges, nodes.sparkSession.createDataFrame([("DbContext",)], "id string")).select("id", F.lit(CONTEXT_TYPES[0]).alias("_base"))
    known = edges.select(F.col("dst").alias("id")).distinct().join(below, "id", "left").select("id", F.array(F.coalesce("_base", F.lit("object"))).alias("_bases"))
    call = (F.col("kind") == "InvocationExpression") & (F.substring_index("text", ".", -1) == "SaveChanges") & (F.size("bases") == 0)
    # other nodes have no key, and so no partner
    keyed = nodes.withColumn("_type", F.when(call, simple(F.col("type"))))
    return keyed.join(known, F.col("_type") == F.col("id"), "left").withColumn("bases", F.coalesce("_bases", "bases")).select(*nodes.columns)


def pragma_without_restore(pragmas: DataFrame) -> DataFrame:
    """(doc_id, line, code) of disabled codes that the file restores nowhere; a bare pragma has the code *."""
    code = F.coalesce(F.nullif(F.col("code"), F.lit("")), F.lit("*"))
    rows = pragmas.select("doc_id", "line", F.lower("action").alias("action"), code.alias("code"))
    return rows.filter("action = 'disable'").join(rows.filter("action = 'restore'").select("doc_id", "code"), ["doc_id", "code"], "left_anti").select("doc_id", "line", "code")


def pragma_violations(pragmas: DataFrame, documents: DataFrame, ordered: bool = False) -> DataFrame:
    where = documents.select("doc_id", "project", F.col("file_path").alias("file"), (F.col("doc_ord") if "doc_ord" in documents.columns else F.lit(0)).cast("long").alias("doc_ord"))
    found = pragma_without_restore(pragmas).join(where, "doc_id").select(
        "project", "file", "line", F.lit("AP007").alias("id"), F.lit("Warning").alias("severity"), F.concat(F.lit("not restored: "), "code").alias("message"), "doc_ord"
    )
    return found.select("*", rank().alias("rank"), F.col("line").cast("long").alias("pos")) if ordered else found.drop("doc_ord")


def detect_antipatterns(nodes: DataFrame, pragmas: DataFrame | None = None, documents: DataFrame | None = None, *, file: str | None = None, project: str | None = None, severity: str = "warning", most: int | None = 100) -> DataFrame:
    """Violations of all detectors of at least a severity, the first `most` in the order of scanning.

    Files are scanned in their order; over each the rules run one after another, each
    from the top. Without a cut there is no order, and no sort.
    """
    found = scan_rules(nodes, tuple(i for i in RULES if i not in STRUCTURAL_RULES), ordered=True)
    if pragmas is not None and documents is not None:
        found = found.unionByName(pragma_violations(pragmas, documents, ordered=True))
    found = found.filter(tx.at_least(F.col("severity"), severity) & tx.contains_ignore_case(F.col("project"), project))
    if file:
        found = found.filter(tx.path_ends_with(F.col("file"), file))
    if most is not None:
        found = found.orderBy("doc_ord", "project", "file", "rank", "pos", "line").limit(most)
    return found.drop("doc_ord", "rank", "pos")


def _module_key(modules: DataFrame) -> list:
    """The columns that tell module classes apart, as far as a front end gives them."""
    return [c for c in ("project", "file", "line", "module") if c in modules.columns]


def _in_order(modules: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    key = _module_key(modules)
    deps = modules.filter("dep IS NOT NULL").groupBy(*key, "dep").agg(F.min("pos").alias("pos"))
    before = F.lag("dep").over(Window.partitionBy(*key).orderBy("pos", "dep"))
    return deps.select(*key, (F.coalesce(before, F.lit("")) > F.col("dep")).alias("_off")).groupBy(*key).agg((~F.bool_or("_off")).alias("in_order"))


def dependency_order(modules: DataFrame) -> DataFrame:
    """(module, in_order): whether each dependency list equals its sorted copy; what is listed again counts once."""
    return _in_order(modules).select("module", "in_order")


def module_violations(modules: DataFrame) -> DataFrame:
    """Convention checks of module dependencies: (module, ..., id, severity).

    Only classes that are named Module and have such a base count; a row that doesn't
    say whether it is one (strict) does.
    """
    key = _module_key(modules)
    if "strict" in modules.columns:
        modules = modules.filter(F.coalesce("strict", F.lit(True)))
    core = modules.filter(F.contains("dep", F.lit("GranitCoreModule"))).select(*key).distinct()
    core = core.select(*key, F.lit("GR-DEPS-CORE").alias("id"), F.lit("Warning").alias("severity"))
    order = _in_order(modules).filter("NOT in_order").select(*key, F.lit("GR-DEPS-ORDER").alias("id"), F.lit("Info").alias("severity"))
    return core.unionByName(order)


def category(id_col: str = "id") -> Column:
    out = F.lit("other")
    for name, kind in CATEGORIES.items():
        out = F.when(F.col(id_col) == name, kind).otherwise(out)
    return out


def validate_conventions(nodes: DataFrame, modules: DataFrame | None = None, *, check: str = "all", project: str | None = None, file: str | None = None) -> DataFrame:
    """Violations of conventions with their category. `all` leaves out AP009, `efcore` has it.

    The case of a category doesn't matter to the detectors, and an unknown one runs all
    of them; structural checks take a category as it is written, and an unknown one runs
    none of them.
    """
    detectors = {k: tuple(i for i in v if i not in STRUCTURAL_RULES) for k, v in BY_CATEGORY.items()}
    ids = detectors.get(check.lower(), CONVENTION_RULES) + tuple(i for i in STRUCTURAL_RULES if check == "all" or i in BY_CATEGORY.get(check, ()))
    chosen = tuple(i for i in ids if i in RULES)
    found = scan_rules(nodes if chosen else nodes.limit(0), chosen or None)
    if modules is not None and "GR-DEPS-CORE" in ids:
        given = lambda c, kind: (F.col(c) if c in modules.columns else F.lit(None)).cast(kind).alias(c)
        own = module_violations(modules).select(given("project", "string"), given("file", "string"), given("line", "int"), "id", "severity", F.col("module").alias("message"))
        found = found.unionByName(own)
    found = found.filter(tx.contains_ignore_case(F.col("project"), project))
    if file:
        found = found.filter(tx.path_ends_with_raw(F.col("file"), file))
    return found.withColumn("category", category())


def by_category(violations: DataFrame) -> DataFrame:
    return violations.groupBy("category").agg(F.count("*").alias("n"))
