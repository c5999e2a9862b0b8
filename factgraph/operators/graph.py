"""Whole-graph analytics: degrees, outliers, scores, cycles, communities, call and module trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factgraph.functions import text as tx
from factgraph.operators.closure import bounded_paths, reachable
from factgraph.operators.cycles import back_edge_cycles
from factgraph.operators.propagation import Blocks
from factgraph.operators.resolve import first_by, last_by
from factgraph.sources.scratch import checkpointed, in_order

# --- edges and degrees ----------------------------------------------------------------


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): how often each edge occurs."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) over distinct edges; one pass, no join of the two sides."""
    distinct = edges.select("src", "dst").distinct()
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return distinct.select(F.inline(ends)).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The sorted element at n / 2, counted from 0; from a histogram, so no list of all values is made."""
    histogram = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # distinct values only
    placed = histogram.select("v", F.sum("n").over(run).alias("upto"))
    half = histogram.agg(F.floor(F.sum("n") / 2).alias("half"))
    return placed.join(F.broadcast(half), F.col("upto") > F.col("half")).agg(F.min("v").alias("upper_median"))


def hub_threshold(degree: DataFrame) -> DataFrame:
    """Mean plus population deviation of the in-degrees of nodes that have one."""
    return degree.filter("in_degree > 0").agg((F.avg("in_degree") + F.stddev_pop("in_degree")).alias("hub_threshold"))


# --- god nodes --------------------------------------------------------------------------


def god_nodes(symbols: DataFrame, refs: DataFrame, threshold: float = 2.0, min_refs: int = 5, most: int | None = 20, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Symbols with unusually many references: display, refs, mean, stddev, z_score.

    Candidates count once each (first project wins), those of the platform not at all;
    symbols without references are part of the statistics. Kept are those with at least
    min_refs and at least mean + threshold * population deviation. One aggregate over
    refs and one join on the symbol, whatever the number of symbols.
    """
    rows = symbols.filter(tx.kind_matches(kind) & tx.contains_ignore_case(F.col("project"), project))
    rows = first_by(rows.select("display", "namespace", "sym_ord"), ["display"], ["sym_ord"])
    rows = rows.filter(~F.coalesce(tx.is_system_namespace(F.coalesce("namespace", F.lit("-"))), F.lit(False)))
    counts = refs.groupBy(F.col("symbol").alias("display")).agg(F.count("*").alias("refs"))
    counted = rows.join(counts, "display", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    stats = counted.agg(F.avg("refs").alias("mean"), F.stddev_pop("refs").alias("stddev"))
    out = (
        counted.join(F.broadcast(stats))  # one row
        .filter((F.col("refs") >= min_refs) & (F.col("refs") >= F.col("mean") + threshold * F.col("stddev")))
        .withColumn("z_score", F.when(F.col("stddev") > 0, (F.col("refs") - F.col("mean")) / F.col("stddev")).otherwise(0.0))
        .select("display", "refs", "mean", "stddev", "z_score", "sym_ord")
    )
    if most is not None:
        out = out.orderBy(F.desc("refs"), "sym_ord").limit(most)
    return out.drop("sym_ord")


# --- surprising dependencies ---------------------------------------------------------------


def surprising_dependencies(edges: DataFrame, owners: DataFrame | None = None, most: int | None = 20) -> DataFrame:
    """Namespace edges that cross what one would expect: src, dst, score, reasons, weight.

    edges: (src, dst) once a reference, or with a weight. owners: (id, project, ord), the
    first of a namespace wins. Score: other project 2, peripheral source (out-degree at
    most half the upper median) 2, hub target (in-degree above mean plus deviation) 1,
    distance of at least 3 segments 1; edges that score nothing are left out. The edges
    and the degrees are stored once, as all else is derived from them; the scalars are
    one row, broadcast.
    """
    weighted = edges if "weight" in edges.columns else edge_weights(edges)
    weighted = checkpointed(weighted.filter("src != dst").select("src", "dst", "weight"))
    degree = checkpointed(degrees(weighted))
    scalars = hub_threshold(degree).join(upper_median(degree.filter("out_degree > 0"), "out_degree"))
    scored = weighted.join(degree.select(F.col("id").alias("src"), "out_degree"), "src").join(degree.select(F.col("id").alias("dst"), "in_degree"), "dst")
    if owners is not None:
        first = owners.groupBy("id").agg(F.min_by("project", "ord").alias("project"))
        scored = scored.join(first.select(F.col("id").alias("src"), F.col("project").alias("src_project")), "src", "left").join(
            first.select(F.col("id").alias("dst"), F.col("project").alias("dst_project")), "dst", "left"
        )
    else:
        scored = scored.withColumn("src_project", F.lit(None).cast("string")).withColumn("dst_project", F.lit(None).cast("string"))
    scored = scored.join(F.broadcast(scalars))
    crosses = F.coalesce((F.lower("src_project") != F.lower("dst_project")) & (F.col("src_project") != "") & (F.col("dst_project") != ""), F.lit(False))
    peripheral = F.col("out_degree") <= F.col("upper_median") / 2
    hub = F.col("in_degree") > F.col("hub_threshold")
    distance = tx.namespace_distance(F.col("src").cast("string"), F.col("dst").cast("string"))
    reasons = F.array_compact(
        F.array(
            F.when(crosses, F.concat(F.lit("cross-assembly ("), "src_project", F.lit(" → "), "dst_project", F.lit(")"))),
            F.when(peripheral, F.concat(F.lit("peripheral source ("), F.col("out_degree").cast("string"), F.lit(" outgoing deps)"))),
            F.when(hub, F.concat(F.lit("hub target ("), F.col("in_degree").cast("string"), F.lit(" incoming deps)"))),
            F.when(distance >= 3, F.concat(F.lit("distant namespaces (depth diff "), distance.cast("string"), F.lit(")"))),
        )
    )
    score = F.when(crosses, 2).otherwise(0) + F.when(peripheral, 2).otherwise(0) + F.when(hub, 1).otherwise(0) + F.when(distance >= 3, 1).otherwise(0)
    out = scored.select("src", "dst", score.alias("score"), reasons.alias("reasons"), "weight").filter("score > 0")
    return out if most is None else out.orderBy(F.desc("score"), F.desc("weight"), "src", "dst").limit(most)


def type_edges(type_refs: DataFrame, symbols: DataFrame, via: tuple[str, ...] | None = None, by: str = "display") -> DataFrame:
    """(src, dst) of structural references between types, or between their namespaces; platform targets and self-edges left out."""
    rows = type_refs if via is None else type_refs.filter(F.col("via").isin(*via))
    if by == "display":
        return rows.filter("src != dst").select("src", "dst")
    spaces = symbols.groupBy("display").agg(F.min_by("namespace", "sym_ord").alias("ns"))
    named = rows.join(spaces.select(F.col("display").alias("src"), F.col("ns").alias("a")), "src").join(spaces.select(F.col("display").alias("dst"), F.col("ns").alias("b")), "dst")
    return named.filter((F.col("a") != F.col("b")) & (F.col("b") != "") & ~tx.is_system_namespace(F.col("a")) & ~tx.is_system_namespace(F.col("b"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


# --- cycles --------------------------------------------------------------------------------


def bounded_cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """All simple cycles of up to `longest` edges, once each, starting at their least node: (nodes, n). Runs distributed."""
    edges = edges.select("src", "dst").filter("src != dst").distinct()
    paths = edges.select(F.array("src", "dst").alias("path"), F.col("src").alias("root"), F.col("dst").alias("node")).filter("node > root")
    out = None
    for n in range(2, longest + 1):
        closed = paths.alias("p").join(edges.alias("e"), (F.col("p.node") == F.col("e.src")) & (F.col("p.root") == F.col("e.dst")))
        part = closed.select(F.array_append("path", F.col("root")).alias("nodes"), F.lit(n).alias("n"))
        out = part if out is None else out.unionByName(part)
        if n < longest:
            # only nodes above the root: every cycle is found from its least node alone
            step = paths.alias("p").join(edges.alias("e"), F.col("p.node") == F.col("e.src"))
            paths = step.filter("e.dst > p.root AND NOT array_contains(p.path, e.dst)").select(F.array_append("path", F.col("e.dst")).alias("path"), "root", F.col("e.dst").alias("node"))
    return out


def circular_dependencies(projects: DataFrame, project_refs: DataFrame, type_refs: DataFrame, symbols: DataFrame, scope: str = "projects", project: str | None = None) -> DataFrame:
    """Cycles of project references or of types, by back edges. A filter keeps edges by their source; targets stay as they are.

    Of types, fields, properties, bases and interfaces count, signatures of methods don't.
    """
    if scope.lower() == "types":
        kept = symbols.filter(tx.contains_ignore_case(F.col("project"), project)).select(F.col("display").alias("src")).distinct()
        edges = type_refs.filter(F.col("via").isin("field", "property", "base", "interface") & (F.col("src") != F.col("dst")))
    else:
        kept = projects.filter(tx.contains_ignore_case(F.col("project"), project)).select(F.col("project").alias("src")).distinct()
        edges = project_refs
    return back_edge_cycles(edges.join(kept, "src", "left_semi"))


# --- communities ------------------------------------------------------------------------------


def communities_exact(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(id, label) by label propagation in place: nodes in ordinal order take the heaviest label around them, ties to the one met first.

    Neighbours are met in the order of edges (ord, then src and dst, either way round). Nodes are
    numbered in their order, so that rounds are about numbers alone.
    """
    rows = edges.select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
        (F.col("weight") if "weight" in edges.columns else F.lit(1)).cast("long").alias("weight"),
        (F.col("ord") if "ord" in edges.columns else F.lit(0)).cast("long").alias("ord"),
    ).filter("src IS NOT NULL AND dst IS NOT NULL")
    rows = checkpointed(rows)
    names = in_order(rows.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), "n", "name")
    number = lambda end: names.select(F.col("name").alias(end), F.col("n").alias(f"_{end}"))
    numbered = rows.join(number("src"), "src").join(number("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight", "ord")
    if "ord" in edges.columns:
        numbered = in_order(numbered, "met", "ord", "src", "dst")
    found = communities_numbered(numbered, iterations)
    name = lambda key: names.select(F.col("n").alias(key), F.col("name").alias(f"_{key}"))
    return found.join(name("id"), "id").join(name("label"), "label").select(F.col("_id").alias("id"), F.col("_label").alias("label"))


def communities_numbered(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """communities_exact of nodes that are numbers, in their order: edges (src, dst, maybe weight, else 1 a row, maybe met, the place where an edge is met), or members as Blocks takes them.

    Within a round a node's label depends on this round's labels of smaller neighbours and last round's of
    larger ones, so the round is the only fix point of all its nodes' rules: all take their
    labels at once, as if the smaller ones kept theirs, and whoever has a smaller neighbour
    that changed does so again, until nobody has. After k passes every node is final that
    no chain of k smaller neighbours leads to, so a round ends. Only nodes next to a change choose again;
    one that goes again without need finds what it has. A pass sends labels between blocks of nodes
    (operators/propagation.py) and is stored; a component of any size is spread over all tasks.
    """
    blocks = Blocks(edges, in_place=True)
    try:
        labels = checkpointed(blocks.start().select("id", F.col("label").alias("last"), "label", F.lit(True).alias("moved")))
        beside = "any"
        for _ in range(iterations):
            while True:
                labels = checkpointed(blocks.pass_in_place(labels, beside))
                if labels.filter("moved").isEmpty():
                    break
                beside = "before"
            labels = labels.select("id", F.col("label").alias("last"), "label", (F.col("label") != F.col("last")).alias("moved"))
            if labels.filter("moved").isEmpty():
                break
            beside = "after"
    finally:
        blocks.drop()
    return labels.select("id", "label")


def _labels_in_sync(edges: DataFrame, iterations: int, inside: bool) -> tuple[DataFrame, DataFrame | None]:
    """Stored labels of communities_sync, and of each label the members' neighbours (Blocks.inside), if asked for."""
    kind = edges.schema["members"].dataType.elementType if "members" in edges.columns else edges.schema["src"].dataType
    names = None
    if not isinstance(kind, IntegralType):
        names = in_order(edges.filter("src != dst").select(F.explode(F.array("src", "dst")).alias("name")).distinct(), "n", "name")
        number = lambda end: names.select(F.col("name").alias(end), F.col("n").alias(f"_{end}"))
        edges = edges.join(number("src"), "src").join(number("dst"), "dst").drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"})
    named = lambda rows, key: rows.withColumn(key, F.col(key).cast(kind)) if names is None else rows.join(names.select(F.col("n").alias(key), "name"), key).drop(key).withColumnRenamed("name", key)
    blocks = Blocks(edges, in_place=False)
    try:
        labels = checkpointed(blocks.start())
        for _ in range(iterations):
            labels = checkpointed(blocks.sync_round(labels))
            if labels.filter("moved").isEmpty():  # nor would any other round change anything
                break
            labels = labels.drop("moved")
        found = checkpointed(blocks.inside(labels.select("id", "label"))) if inside else None
    finally:
        blocks.drop()
    return named(named(labels, "id"), "label").select("id", "label"), named(found, "label") if inside else None


def communities_sync(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """(id, label): all nodes take at once the heaviest label around them, ties to the least; a fixed number of rounds.

    edges: src, dst, maybe weight, else 1 a row; or members, an array of numbers a row, each two of which are an edge. A
    round sends labels between blocks of nodes (operators/propagation.py).
    """
    return _labels_in_sync(edges, iterations, False)[0]


def communities_sync_stats(edges: DataFrame, iterations: int = 5, most: int | None = 30) -> DataFrame:
    """community_stats of communities_sync: inner edges are counted where the labels were found, block by block."""
    return _shown_stats(*_labels_in_sync(edges, iterations, True), most)


def community_stats(labels: DataFrame, edges: DataFrame, most: int | None = 30) -> DataFrame:
    """(label, members, cohesion): edges inside as a share of the members' edges; 1 for one member, 0 without edges."""
    both = mirrored(edges).filter("src != dst").distinct()
    joined = both.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst", "left")
    inside = joined.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("total"), F.count_if(F.col("a") == F.col("b")).alias("intra"))
    return _shown_stats(labels, inside, most)


def _shown_stats(labels: DataFrame, inside: DataFrame, most: int | None) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    out = sizes.join(inside, "label", "left").select(
        "label", "members", F.when(F.col("members") <= 1, 1.0).when(F.col("total").isNull(), 0.0).otherwise(F.col("intra") / F.col("total")).alias("cohesion")
    )
    return out if most is None else out.orderBy(F.desc("members"), "label").limit(most)


def community_members(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, id, degree, nth): the members of each community, those with the most neighbours first, then by id; nth counts from 0.

    All are sorted in one order by many tasks, so a community of any size is split.
    """
    degree = degrees(mirrored(edges)).select("id", F.col("out_degree").alias("degree"))
    rows = labels.join(degree, "id", "left").select("label", (-F.coalesce("degree", F.lit(0))).alias("_less"), "id")
    placed = in_order(rows, "_place", "label", "_less", "id")
    begins = placed.groupBy("label").agg(F.min("_place").alias("_begin"))
    return placed.join(begins, "label").select("label", "id", (-F.col("_less")).alias("degree"), (F.col("_place") - F.col("_begin")).alias("nth"))


# --- project, call and module graphs ---------------------------------------------------------


def project_graph(projects: DataFrame, refs: DataFrame, project: str | None = None, transitive: bool = False, most: int | None = 50) -> DataFrame:
    """(project, target_framework, refs array, total): direct references; total counts before the cut."""
    wanted = projects
    if project:
        names = [n.lower() for n in tx.comma_list(project)]
        wanted = projects.filter(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower("project"), n)))
        if transitive:
            inside = reachable(refs, wanted.select(F.col("project").alias("id")), fold=True).select("id")
            wanted = projects.join(inside, F.lower("project") == F.col("id"), "left_semi")
    listed = refs.groupBy(F.col("src").alias("project")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("refs"))
    total = wanted.agg(F.count("*").alias("total"))
    out = wanted.join(listed, "project", "left").join(F.broadcast(total)).select(
        "project", "target_framework", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), "total", "ord"
    )
    return (out if most is None else out.orderBy("ord", "project").limit(most)).drop("ord")


def dependency_rows(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """All call paths of up to `depth` steps: (root, path, node, depth)."""
    return bounded_paths(edges, start, depth).drop("is_stub")


def dependency_tree(calls: DataFrame, root: str | DataFrame, depth: int = 3) -> DataFrame:
    """The call tree in the order of calls, each symbol expanded once: (pos, path, node, depth).

    Calls are taken in the order of ord, then of what is called; later occurrences of an expanded symbol
    are leaves, repeated calls stay repeated. The root is a display string or a table (id) of at most one; one that
    calls nothing is alone, an empty string or table has no tree.

    An occurrence's place is the key of its path. A symbol is expanded where its key is the
    smallest of those above the last level, and which occurrences there are depends on smaller
    keys alone, so there is one fix point: each round hangs what is called below the present
    expansions and picks each symbol's smallest again. Occurrences are never more than calls;
    the driver sees a row a round.
    """
    spark = calls.sparkSession
    start = root.select(F.col("id").cast("string").alias("id")) if isinstance(root, DataFrame) else spark.createDataFrame([(root,)] if root else [], "id string")
    kind = "array<struct<ord: long, callee: string, nth: long>>"
    start = start.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array().cast(kind).alias("key"))
    inside = reachable(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), start.select(F.col("node").alias("id")), depth)
    own = calls.filter("callee IS NOT NULL").join(inside.select(F.col("id").alias("caller")), "caller", "left_semi").groupBy("caller", "ord", "callee").agg(F.count("*").alias("n"))
    own = own.select("caller", "ord", "callee", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    own = checkpointed(own.select("caller", F.struct(F.col("ord").cast("long").alias("ord"), F.col("callee").cast("string").alias("callee"), "nth").alias("step")))

    def hung(expanded: DataFrame) -> DataFrame:
        below = own.join(expanded.withColumnRenamed("node", "caller"), "caller")
        return start.unionByName(below.select("root", F.col("step.callee").alias("node"), F.concat("key", F.array("step").cast(kind)).alias("key")))

    expanded, moved = start.limit(0), True
    while moved:
        # on the last level nothing hangs below, so it doesn't keep a symbol from being expanded elsewhere
        now = checkpointed(hung(expanded).filter(F.size("key") < depth).groupBy("root", "node").agg(F.min("key").alias("key")))
        both = now.join(expanded.select("node", F.col("key").alias("_old")), "node", "full")
        expanded, moved = now, not both.filter("key IS NULL OR _old IS NULL OR key != _old").isEmpty()
    path = F.concat(F.array("root"), F.transform("key", lambda step: step["callee"]))
    return in_order(hung(expanded), "pos", "key").select(F.col("pos").cast("int").alias("pos"), path.alias("path"), "node", F.size("key").alias("depth"))


def module_candidates(name_col):
    """Names that a module may be listed under, first match first; the same again ignoring case."""
    plain = F.array(name_col, F.concat(name_col, F.lit("Module")), F.concat(F.lit("Granit"), name_col, F.lit("Module")))
    return F.concat(F.transform(plain, lambda x, i: F.struct(x.alias("_cand"), i.alias("rank"), F.lit(False).alias("fold"))), F.transform(plain, lambda x, i: F.struct(F.lower(x).alias("_cand"), (i + 3).alias("rank"), F.lit(True).alias("fold"))))


def resolve_modules(names: DataFrame, modules: DataFrame, column: str = "name") -> DataFrame:
    """names with `resolved`: the module each one means, null if none."""
    known = last_by(modules.select("module", "project").withColumn("_o", F.lit(0)), ["module"], ["_o", "project"]).select("module")
    asked = names.select(column).distinct().select(column, F.inline(module_candidates(F.col(column))))
    exact = asked.filter("NOT fold").join(known, F.col("_cand") == F.col("module"))
    folded = asked.filter("fold").join(known.withColumn("_l", F.lower("module")), F.col("_cand") == F.col("_l")).drop("_l")
    best = exact.unionByName(folded).groupBy(F.col(column).alias("_n")).agg(F.min_by("module", F.struct("rank", "module")).alias("resolved"))
    return names.join(best, F.col(column) == F.col("_n"), "left").drop("_n")


def module_tree(modules: DataFrame, name: str | DataFrame, depth: int = 3, direction: str = "dependencies") -> DataFrame:
    """Module paths from one module (a name, or a table with one): (path, node, depth, is_stub, known).

    A node repeats in other branches; on its own path it is a stub.
    """
    deps = modules.filter("dep IS NOT NULL")
    edges = resolve_modules(deps.select("module", F.col("dep").alias("name")), modules).select(F.col("module").alias("src"), F.coalesce("resolved", "name").alias("dst"))
    if direction.lower() == "dependents":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    asked = name.select("name") if isinstance(name, DataFrame) else modules.sparkSession.createDataFrame([(name,)], "name string")
    start = resolve_modules(asked, modules).filter("resolved IS NOT NULL").select(F.col("resolved").alias("id"))
    known = modules.select(F.col("module").alias("node")).distinct().withColumn("known", F.lit(True))
    return bounded_paths(edges.distinct(), start, depth, stubs=True).drop("root").join(known, "node", "left").select("path", "node", "depth", "is_stub", F.coalesce("known", F.lit(False)).alias("known"))


def module_facts(symbols: DataFrame, inherits: DataFrame, attributes: DataFrame) -> DataFrame:
    """modules rows from declarations: classes named ...Module or with such a base, where they stand, and what they depend on. strict: both hold."""
    based = inherits.filter(F.contains("parent", F.lit("Module"))).select(F.col("child").alias("display")).distinct().withColumn("_b", F.lit(True))
    own = symbols.filter((F.lower("kind") == "type") & (F.lower("type_kind") == "class")).join(based, "display", "left")
    named, has_base = F.endswith("name", F.lit("Module")), F.coalesce("_b", F.lit(False))
    args = attributes.filter(F.col("name").isin("DependsOn", "DependsOnAttribute") & (F.col("arg_kind") == "TypeOfExpression")).select(F.col("owner").alias("display"), F.col("arg_text").alias("dep"), "pos")
    return own.filter(named | has_base).join(args, "display", "left").select(
        F.col("name").alias("module"), "project", "dep", F.coalesce("pos", F.lit(0)).alias("pos"), "file", "line", (named & has_base).alias("strict")
    )
