"""Metrics of methods from their syntax nodes, body fingerprints, data and control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.sources.scratch import checkpointed

# --- fixed values: names of syntax node kinds -----------------------------------------------

#: Each adds a path.
BRANCHES = (
    "IfStatement", "WhileStatement", "ForStatement", "ForEachStatement", "CaseSwitchLabel", "CasePatternSwitchLabel",
    "ConditionalExpression", "CatchClause", "LogicalAndExpression", "LogicalOrExpression", "CoalesceExpression", "SwitchExpressionArm",
)
#: Each costs one plus its nesting, and nests.
NESTING = (
    "WhileStatement", "ForStatement", "ForEachStatement", "DoStatement", "SwitchStatement", "SwitchExpression", "CatchClause", "ConditionalExpression",
)
#: Each costs one.
FLAT = ("LogicalAndExpression", "LogicalOrExpression")
#: Each nests at no cost.
LAMBDAS = ("SimpleLambdaExpression", "ParenthesizedLambdaExpression")
#: A block right below one of these is a level of nesting.
BLOCK_PARENTS = (
    "IfStatement", "ElseClause", "WhileStatement", "ForStatement", "ForEachStatement", "DoStatement", "TryStatement", "CatchClause",
    "FinallyClause", "SwitchStatement", "LockStatement", "UsingStatement",
)
#: What a fingerprint writes for a node, without looking below it.
MASKED = {"IdentifierName": "ID", "PredefinedType": "TYPE"}
LITERALS = (
    "StringLiteralExpression", "NumericLiteralExpression", "CharacterLiteralExpression", "TrueLiteralExpression", "FalseLiteralExpression",
    "NullLiteralExpression", "DefaultLiteralExpression", "Utf8StringLiteralExpression",
)


def cyclomatic(nodes: DataFrame) -> DataFrame:
    """(owner_symbol, cyclomatic): 1 and the branching nodes of each method."""
    return nodes.groupBy("owner_symbol").agg((F.count_if(F.col("kind").isin(*BRANCHES)) + 1).cast("int").alias("cyclomatic"))


def max_nesting(nodes: DataFrame) -> DataFrame:
    """(owner_symbol, max_nesting): nested blocks, as a running sum over the places where they open and close."""
    parent = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    blocks = nodes.filter("kind = 'Block'").join(parent, ["doc_id", "parent_id"]).filter(F.col("parent_kind").isin(*BLOCK_PARENTS))
    # post is the last place inside: the block closes after it
    steps = blocks.select("doc_id", "owner_symbol", F.inline(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("step")), F.struct((F.col("post") + 1).alias("at"), F.lit(-1).alias("step")))))
    run = Window.partitionBy("doc_id", "owner_symbol").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    deepest = steps.select("owner_symbol", F.sum("step").over(run).alias("depth")).groupBy("owner_symbol").agg(F.max("depth").cast("int").alias("max_nesting"))
    return nodes.select("owner_symbol").distinct().join(deepest, "owner_symbol", "left").select("owner_symbol", F.coalesce("max_nesting", F.lit(0)).alias("max_nesting"))


def _passed_over(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, node_id): each `if` that is the statement of an `if` that isn't one itself.

    Such a one is not looked at as an `if`, so in a row of them every second is. Rounds are as
    many as the longest such row has, most often none.
    """
    links = rows.filter("kind = 'IfStatement' AND part = 'body'").select(*key, "node_id", "parent_id")
    todo = checkpointed(links)
    heads = todo.select(*key, F.col("parent_id").alias("node_id")).join(todo, [*key, "node_id"], "left_anti").distinct()
    known, out = heads.withColumn("counts", F.lit(True)), todo.select(*key, "node_id").limit(0)
    while not todo.isEmpty():
        step = checkpointed(todo.join(known.withColumnRenamed("node_id", "parent_id"), [*key, "parent_id"]).select(*key, "node_id", (~F.col("counts")).alias("counts")))
        out = out.unionByName(step.filter("NOT counts").drop("counts"))
        todo, known = checkpointed(todo.join(step, [*key, "node_id"], "left_anti")), step
    return out


def cognitive(nodes: DataFrame) -> DataFrame:
    """(owner_symbol, cognitive) by one running sum over the places of each method's tree.

    An `if` costs one plus its nesting; its condition is not looked at, nor its statement
    itself, but what is in it. `else` costs one; an `if` right below it counts as nested no
    deeper than the first. What nests adds one where it opens and takes it back where it
    closes, conditions do so in a sum of their own, and a node's nesting is the sum at its place.
    """
    key = ["doc_id", "owner_symbol"]
    own = nodes.filter("owner_symbol IS NOT NULL").select(*key, "node_id", "parent_id", "pre", "post", "kind")
    rows = own.join(own.select(*key, F.col("node_id").alias("parent_id"), F.col("kind").alias("above")), [*key, "parent_id"], "left")
    is_else, below_if = F.col("kind") == "ElseClause", F.col("above") == "IfStatement"
    # of an `if`'s children but `else` the last is the statement, the ones before it are the condition
    last = F.max(F.when(~is_else, F.col("pre"))).over(Window.partitionBy(*key, "parent_id"))
    rows = rows.withColumn("part", F.when(below_if & is_else, "else").when(below_if & (F.col("pre") == last), "body").when(below_if, "head"))
    chained = rows.filter("kind = 'IfStatement' AND above = 'ElseClause'").select(*key, F.col("parent_id").alias("node_id"), F.lit(True).alias("chained")).distinct()
    plain = _passed_over(rows, key).select(*key, F.col("node_id").alias("parent_id"), F.lit(True).alias("plain"))
    rows = rows.join(plain, [*key, "parent_id"], "left").join(chained, [*key, "node_id"], "left").withColumn("part", F.when(F.col("plain").isNull(), F.col("part")))
    kind = F.when(F.coalesce(F.col("part") != "body", F.lit(True)), F.col("kind"))
    nests = (F.col("part") == "body") | ((F.col("part") == "else") & F.col("chained").isNull()) | kind.isin(*NESTING, *LAMBDAS)
    costs = F.when(kind.isin("IfStatement", *NESTING), 2).when(kind.isin(*FLAT) | (F.col("part") == "else"), 1).otherwise(0)
    event = lambda at, nest, hide, cost: F.struct(at.cast("long").alias("at"), F.lit(nest).alias("nest"), F.lit(hide).alias("hide"), cost.alias("cost"))
    none, after = F.lit(0), F.col("post") + 1
    events = F.array(
        F.when(nests, event(F.col("pre") + 1, 1, 0, none)), F.when(nests, event(after, -1, 0, none)),
        F.when(F.col("part") == "head", event(F.col("pre"), 0, 1, none)), F.when(F.col("part") == "head", event(after, 0, -1, none)),
        F.when(costs > 0, event(F.col("pre"), 0, 0, costs)),
    )
    # at one place steps come before the node that stands there
    run = Window.partitionBy(*key).orderBy("at", F.col("cost") > 0).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(*key, F.inline(F.array_compact(events))).select("owner_symbol", "cost", F.sum("nest").over(run).alias("nest"), F.sum("hide").over(run).alias("hide"))
    worth = F.when(F.col("hide") > 0, 0).when(F.col("cost") == 2, 1 + F.col("nest")).otherwise(F.col("cost"))
    found = summed.groupBy("owner_symbol").agg(F.sum(worth).alias("cognitive"))
    return own.select("owner_symbol").distinct().join(found, "owner_symbol", "left").select("owner_symbol", F.coalesce("cognitive", F.lit(0)).cast("int").alias("cognitive"))


def complexity(nodes: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """All metrics of each method: owner_symbol, cyclomatic, cognitive, max_nesting, logical_loc."""
    out = cyclomatic(nodes).join(cognitive(nodes), "owner_symbol", "left").join(max_nesting(nodes), "owner_symbol", "left")
    if bodies is not None:
        out = out.join(bodies.select("owner_symbol", tx.logical_lines(F.col("text")).alias("logical_loc")), "owner_symbol", "left")
    return out


def complexity_metrics(metrics: DataFrame, symbols: DataFrame, name: str | None = None, scope: str = "method", class_name: str | None = None, threshold: int = 0, most: int | None = 50, strict_topk: bool = False) -> DataFrame:
    """Metrics of one method, of a type's or a project's methods.

    For a type or project those of at least the threshold are cut to the first `most`
    in the order of scanning and then sorted; strict_topk sorts first. None: no cut.
    """
    rows = metrics.join(symbols.select(F.col("display").alias("owner_symbol"), "name", "container_name", "project", "file", "line", "sym_ord"), "owner_symbol")
    if scope.lower() == "method":
        found = rows.filter(tx.equals_ignore_case(F.col("name"), name) & tx.equals_ignore_case(F.col("container_name"), class_name))
        return found.orderBy("sym_ord").limit(1)
    found = rows.filter(tx.equals_ignore_case(F.col("container_name" if scope.lower() == "type" else "project"), name) & (F.col("cyclomatic") >= threshold))
    by_value = [F.desc("cyclomatic"), F.asc("sym_ord")]
    if most is None:
        return found.orderBy(*by_value)
    return found.orderBy(*by_value).limit(most) if strict_topk else found.orderBy("sym_ord").limit(most).orderBy(*by_value)


def normalized_bodies(nodes: DataFrame) -> DataFrame:
    """(owner_symbol, normalized, statements): kinds of a body's nodes in order, names, literals and types masked.

    A masked node hides what is below it: whatever starts before the last place of an
    earlier masked node. One window a method.
    """
    masked = F.when(F.col("kind").isin(*MASKED), F.col("kind")).when(F.col("kind").isin(*LITERALS), F.lit("literal"))
    before = Window.partitionBy("doc_id", "owner_symbol").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.max(F.when(masked.isNotNull(), F.col("post"))).over(before)
    shown = nodes.withColumn("_hidden", hidden).filter("_hidden IS NULL OR pre > _hidden")
    label = F.when(F.col("kind").isin(*LITERALS), F.lit("LIT"))
    for k, v in MASKED.items():
        label = label.when(F.col("kind") == k, F.lit(v))
    word = label.otherwise(F.col("kind"))
    return shown.groupBy("owner_symbol").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", word.alias("w")))), lambda x: x["w"]), " ").alias("normalized"),
        F.count_if(F.endswith("kind", F.lit("Statement"))).cast("int").alias("statements"),
    )


def data_flow(flow: DataFrame, method: str | None = None) -> DataFrame:
    """(method, role, variables): the variables that a method declares, reads, writes, captures, one list a role."""
    rows = flow if method is None else flow.filter(F.col("method") == method)
    return rows.groupBy("method", "role").agg(F.sort_array(F.collect_set("variable")).alias("variables"))


def control_flow(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, reachable, exits, returns, end_reachable) from the edges of control flow graphs.

    edges: (method, src, dst, kind); kind `return` leads out of the method, `end` to its
    last point. Reachability of all methods is one walk over (method, block) nodes. The
    edges are stored once, as each round of the walk reads them.
    """
    from factgraph.operators.closure import reachable
    from factgraph.sources.scratch import checkpointed

    edges = checkpointed(edges.select("method", "src", "dst", "kind"))
    node = lambda c: F.struct("method", F.col(c).alias("block"))
    keyed = edges.select(F.to_json(node("src")).alias("src"), F.to_json(node("dst")).alias("dst"))
    start = edges.select(F.to_json(F.struct("method", F.lit(entry).alias("block"))).alias("id")).distinct()
    seen = reachable(keyed, start).select("id")
    live = edges.withColumn("id", F.to_json(node("src"))).join(seen, "id", "left_semi")
    counts = live.groupBy("method").agg(
        F.count_if(F.col("kind").isin("return", "throw")).alias("exits"), F.count_if(F.col("kind") == "return").alias("returns"), (F.count_if(F.col("kind") == "end") > 0).alias("end_reachable")
    )
    per = seen.select(F.get_json_object("id", "$.method").alias("method")).groupBy("method").agg(F.count("*").alias("reachable"))
    return per.join(counts, "method", "left")


def token_reduction(rows: DataFrame) -> DataFrame:
    """(median_reduction, pooled_reduction, n) of rows (response, source): how much smaller responses are than sources."""
    each = 1 - F.col("response") / F.col("source")
    return rows.agg(F.median(each).alias("median_reduction"), (1 - F.sum("response") / F.sum("source")).alias("pooled_reduction"), F.count("*").alias("n"))


def largest(rows: DataFrame, size: str, most: int = 20, key: str = "name") -> DataFrame:
    """The `most` rows with the greatest size, ties by key: a bounded sort."""
    return rows.orderBy(F.desc(size), key).limit(most)
