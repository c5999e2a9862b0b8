"""Names bound to what they mean, as ranked equi-joins over fact tables: innermost wins.

A name in a place has a few candidates (a local of an enclosing block, a member of the type or of what
it inherits, a type of an enclosing namespace or of a `using`); each is a key, all are looked
up by one join, and `min_by` over their ranks keeps the innermost that exists. Types of
expressions are found from the inside out in rounds: a member access needs its
receiver's type, a call that of what it calls, a `var` that of its initial value. Each
round joins only what became known in the round before, and is stored; there are as many as chains
of accesses are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.closure import transitive_closure
from factgraph.sources.scratch import checkpointed

ACCESSES = ("SimpleMemberAccessExpression", "ConditionalAccessExpression")
#: Rank of a `using`, and what a step out of a type costs: more than inheritance is deep.
_USING, _OUT = 100_000, 1_000


def plain_type(written: Column) -> Column:
    """A type's name without type arguments and `?`; null for arrays, tuples and `var`, which name no type."""
    bare = F.regexp_replace(F.regexp_replace(written, r"\s+", ""), r"<.*>|\?$", "")
    return F.when(F.contains(bare, F.lit("[")) | F.startswith(bare, F.lit("(")) | bare.isin("", "var"), F.lit(None)).otherwise(bare)


def outer(display: Column) -> Column:
    """The place that something is declared in: its display string without the last name."""
    return F.regexp_replace(display, r"(^|\.)[^.]*$", "")


def bind_types(asked: DataFrame, symbols: DataFrame, usings: DataFrame) -> DataFrame:
    """asked (written, place, doc_id, ...) with `type`: the declared type that a name means in a place of a document; null: none.

    Looked up are, in this order, types below the place and each place around it, the name as
    it is written, and types of the namespaces that the document uses; of several of those
    the smallest. usings: doc_id, namespace.
    """
    types = symbols.filter(F.lower("kind") == "type").select(F.col("display").alias("_display")).distinct()
    names = asked.select("written", "place", "doc_id").filter("written IS NOT NULL").distinct().withColumn("_name", plain_type(F.col("written"))).filter("_name IS NOT NULL")
    parts = F.when(F.col("place") == "", F.array().cast("array<string>")).otherwise(F.split("place", r"\."))
    around = F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
        lambda n: F.struct((F.size(parts) - n).alias("_rank"), F.concat_ws(".", F.slice(parts, F.lit(1), n), F.col("_name")).alias("_display")),
    )
    inside = names.select("written", "place", "doc_id", F.inline(around))
    used = names.join(usings.select("doc_id", "namespace").distinct(), "doc_id").select("written", "place", "doc_id", F.lit(_USING).alias("_rank"), F.concat_ws(".", "namespace", "_name").alias("_display"))
    found = inside.unionByName(used).join(types, "_display").groupBy("written", "place", "doc_id").agg(F.min_by("_display", F.struct("_rank", "_display")).alias("type"))
    return asked.join(found, ["written", "place", "doc_id"], "left")


def bind_inherits(symbols: DataFrame, inherits: DataFrame, usings: DataFrame, documents: DataFrame) -> DataFrame:
    """The inherits facts with bases by their display strings, where the solution declares them; rel follows what they are."""
    where = _places(symbols, documents)
    asked = inherits.join(where.select(F.col("display").alias("child"), "doc_id"), "child").select("child", F.col("parent").alias("written"), "rel", "ord", outer(F.col("child")).alias("place"), "doc_id")
    shape = symbols.filter(F.lower("kind") == "type").groupBy(F.col("display").alias("type")).agg(F.min_by("type_kind", "sym_ord").alias("_kind"))
    bound = bind_types(asked, symbols, usings).join(shape, "type", "left")
    rel = F.when(F.col("_kind") == "interface", "interface").when(F.col("_kind").isNotNull(), "base").otherwise(F.col("rel"))
    return bound.select("child", F.coalesce("type", "written").alias("parent"), rel.alias("rel"), "ord").distinct()


def _places(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """(display, doc_id): the documents that declare a symbol."""
    files = documents.select(F.col("file_path").alias("file"), "doc_id")
    return symbols.join(files, "file").select("display", "doc_id").distinct()


def typed_members(symbols: DataFrame, usings: DataFrame, documents: DataFrame) -> DataFrame:
    """(container, name, symbol, kind, type): methods, fields and properties with the type that they give."""
    files = documents.select(F.col("file_path").alias("file"), "doc_id")
    own = symbols.filter(F.lower("kind").isin("method", "field", "property")).join(files, "file", "left")
    asked = own.select(F.col("display").alias("symbol"), "name", F.lower("kind").alias("kind"), "sym_ord", F.col("return_type").alias("written"), outer(F.col("display")).alias("place"), "doc_id")
    bound = bind_types(asked, symbols, usings)
    return bound.groupBy(F.col("place").alias("container"), "name", "symbol").agg(F.min_by("kind", "sym_ord").alias("kind"), F.min_by("type", "sym_ord").alias("type"))


def lineage(inherits: DataFrame) -> DataFrame:
    """(type, above, depth): each type that has bases with all of them at their shortest distance."""
    edges = inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return transitive_closure(edges).filter("src != dst").select(F.col("src").alias("type"), F.col("dst").alias("above"), "depth")


def find_members(asked: DataFrame, members: DataFrame, above: DataFrame) -> DataFrame:
    """asked (type, name) with the member that is nearest to the type: symbol, kind, gives, depth.

    Of several at one distance the smallest container's counts. One row for each pair that has a member.
    """
    pairs = asked.select("type", "name").distinct()
    near = pairs.select("type", "name", F.col("type").alias("container"), F.lit(0).alias("depth"))
    far = pairs.join(above, "type").select("type", "name", F.col("above").alias("container"), "depth")
    hit = near.unionByName(far).join(members.withColumnRenamed("type", "gives"), ["container", "name"])
    best = hit.groupBy("type", "name").agg(F.min_by(F.struct("symbol", "kind", "gives", "depth"), F.struct("depth", "container", "symbol")).alias("m"))
    return best.select("type", "name", "m.*")


def local_names(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, owner_symbol, name, low, high, written, value_id): locals, and parameters, with the interval of nodes that sees them.

    A local is seen in the block that holds its declaration, that of a loop or a `using` in the
    statement, a lambda's parameter in the lambda. written: the type as it stands there; value_id: the first value of a `var`.
    What stands around declarations is picked out of the nodes and stored, step by step: in one job all
    nodes were shuffled for each join, and all of that lay on disk at once.
    """
    at = nodes.select("doc_id", "owner_symbol", "node_id", "parent_id", "kind", "text", "pre", "post")
    up = lambda p: at.select("doc_id", F.col("node_id").alias("parent_id" if p == "p" else "p_parent"), F.col("kind").alias(f"{p}_kind"), F.col("pre").alias(f"{p}_pre"), F.col("post").alias(f"{p}_post"), F.col("parent_id").alias(f"{p}_parent"))
    own = checkpointed(at.filter("kind IN ('VariableDeclarator', 'Parameter') AND text != ''"))
    loops = at.filter("kind = 'ForEachStatement' AND text != ''")
    parents = checkpointed(up("p").join(own, ["doc_id", "parent_id"], "left_semi"))
    above = checkpointed(up("g").join(parents, ["doc_id", "p_parent"], "left_semi"))
    heads = own.select("doc_id", F.col("parent_id").alias("of")).unionByName(own.select("doc_id", F.col("node_id").alias("of"))).unionByName(loops.select("doc_id", F.col("node_id").alias("of")))
    first = at.select("doc_id", F.col("parent_id").alias("of"), F.col("pre").alias("f_pre"), F.col("text").alias("f_text"), F.col("node_id").alias("f_id"))
    first = checkpointed(first.join(heads, ["doc_id", "of"], "left_semi"))
    own = own.join(parents, ["doc_id", "parent_id"]).join(above, ["doc_id", "p_parent"], "left")
    # the type is the first child of what holds the declaration, the value the only child of the name
    typed = own.join(first.select("doc_id", F.col("of").alias("parent_id"), F.col("f_pre").alias("t_pre"), F.col("f_text").alias("t_text")), ["doc_id", "parent_id"], "left").filter("t_pre IS NULL OR t_pre = p_pre + 1")
    valued = typed.join(first.select("doc_id", F.col("of").alias("node_id"), F.col("f_pre").alias("v_pre"), F.col("f_id").alias("value_id")), ["doc_id", "node_id"], "left").filter("v_pre IS NULL OR v_pre = pre + 1")
    held = F.col("p_kind") == "LocalDeclarationStatement"
    headed = F.col("p_kind").isin("ForStatement", "UsingStatement", "FixedStatement", "SimpleLambdaExpression")
    plain = valued.select(
        "doc_id", "owner_symbol", F.col("text").alias("name"),
        F.when(held, F.col("g_pre")).when(headed, F.col("p_pre")).otherwise(-1).alias("low"), F.when(held, F.col("g_post")).when(headed, F.col("p_post")).otherwise(2**31 - 1).alias("high"),
        F.when((F.col("kind") == "VariableDeclarator") & (held | headed), F.col("t_text")).alias("written"), F.when(held | headed, F.col("value_id")).alias("value_id"),
    )
    each = loops.join(first.withColumnRenamed("of", "node_id"), ["doc_id", "node_id"]).filter("f_pre = pre + 1").select(
        "doc_id", "owner_symbol", F.col("text").alias("name"), F.col("pre").alias("low"), F.col("post").alias("high"), F.col("f_text").alias("written"), F.lit(None).cast("int").alias("value_id")
    )
    given = symbols.filter(F.lower("kind") == "method").select(F.col("display").alias("owner_symbol"), F.explode("params").alias("p"))
    owners = nodes.select("doc_id", "owner_symbol").distinct()
    given = given.join(owners, "owner_symbol").select("doc_id", "owner_symbol", F.col("p.name").alias("name"), F.lit(-2).alias("low"), F.lit(2**31 - 1).alias("high"), F.col("p.type").alias("written"), F.lit(None).cast("int").alias("value_id"))
    return plain.unionByName(each).unionByName(given.distinct())


def placed_nodes(nodes: DataFrame) -> DataFrame:
    """Stored nodes of bodies with `home`, the type that their method is in."""
    return checkpointed(nodes.select("doc_id", "owner_symbol", "node_id", "parent_id", "kind", "text", "pre", "post").withColumn("home", outer(F.col("owner_symbol"))))


def visible_members(symbols: DataFrame, inherits: DataFrame, usings: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (typed_members, lineage) for find_members: a class shows what its bases have, an interface what those above it have.

    A class doesn't show its interfaces' members.
    """
    faces = symbols.filter(F.lower("type_kind") == "interface").select(F.col("display").alias("child")).distinct().withColumn("_face", F.lit(True))
    shown = inherits.join(faces, "child", "left").filter("rel = 'base' OR _face")
    return checkpointed(typed_members(symbols, usings, documents)), checkpointed(lineage(shown))


def bind_leaves(at: DataFrame, symbols: DataFrame, inherits: DataFrame, usings: DataFrame, members: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (known, seen): what names without a receiver and new objects mean, as bind_nodes gives it, and of locals what they are.

    at: nodes with `home`, the type that their method is in. seen: doc_id, node_id, type, value_id
    (the first value of a `var`). No rounds are needed here.
    """
    shape = "doc_id", "node_id", "symbol", "kind", "type"
    # of an access only what it begins with has no receiver
    parent = at.filter(F.col("kind").isin(*ACCESSES)).select("doc_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"))
    names = at.filter("kind = 'IdentifierName' AND text != ''").withColumnRenamed("text", "name").join(parent, ["doc_id", "parent_id"], "left")
    names = checkpointed(names.filter("p_pre IS NULL OR pre = p_pre + 1").select("doc_id", "owner_symbol", "home", "node_id", "pre", "name"))

    # locals of the innermost block
    local = bind_types(local_names(at, symbols).withColumn("place", outer(F.col("owner_symbol"))), symbols, usings)
    seen = names.join(local.drop("place"), ["doc_id", "owner_symbol", "name"]).filter("pre >= low AND pre <= high")
    seen = checkpointed(seen.groupBy("doc_id", "node_id").agg(F.max_by(F.struct("type", F.when(F.col("written") == "var", F.col("value_id")).alias("value_id")), "low").alias("v")).select("doc_id", "node_id", "v.*"))
    free = names.join(seen, ["doc_id", "node_id"], "left_anti")

    # this and base; members of the type, what it inherits and what is around it
    fathers = inherits.filter("rel = 'base'").groupBy(F.col("child").alias("home")).agg(F.min_by("parent", "ord").alias("type"))
    none = F.lit(None).cast("string")
    this = free.filter("name = 'this'").select("doc_id", "node_id", none.alias("symbol"), none.alias("kind"), F.col("home").alias("type"))
    base = free.filter("name = 'base'").join(fathers, "home").select("doc_id", "node_id", none.alias("symbol"), none.alias("kind"), "type")
    rest = free.filter("name NOT IN ('this', 'base')")
    parts = F.split("home", r"\.")
    rings = rest.select("home", "name").distinct().select("home", "name", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))).alias("ring", "type"))
    inner = rings.join(find_members(rings, members, above), ["type", "name"]).groupBy("home", "name").agg(F.min_by(F.struct("symbol", "kind", F.col("gives").alias("type")), F.col("ring") * _OUT + F.col("depth")).alias("m"))
    own = checkpointed(rest.join(inner, ["home", "name"], "left").select("doc_id", "node_id", "home", "name", "m.*"))
    # what is no member may be a type, the receiver of a static one
    typed = bind_types(own.filter("symbol IS NULL").select("doc_id", "node_id", F.col("name").alias("written"), F.col("home").alias("place")), symbols, usings).filter("type IS NOT NULL")
    typed = typed.select("doc_id", "node_id", F.col("type").alias("symbol"), F.lit("type").alias("kind"), "type")
    made = at.filter("kind = 'ObjectCreationExpression' AND text != ''").select("doc_id", "node_id", F.col("text").alias("written"), F.col("home").alias("place"))
    made = bind_types(made, symbols, usings).filter("type IS NOT NULL").select("doc_id", "node_id", F.col("type").alias("symbol"), F.lit("type").alias("kind"), "type")
    known = this.unionByName(base).unionByName(own.filter("symbol IS NOT NULL").select(*shape)).unionByName(typed).unionByName(made)
    known = known.unionByName(seen.select("doc_id", "node_id", none.alias("symbol"), none.alias("kind"), "type"))
    return checkpointed(known), seen


def bind_nodes(nodes: DataFrame, symbols: DataFrame, inherits: DataFrame, usings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, node_id, symbol, kind, type): of names, accesses and calls in bodies what they mean and the type that they give.

    symbol and kind are null for locals, type is null where none of the solution is known;
    nodes of which nothing is known have no row. inherits: bound (bind_inherits).
    """
    at = placed_nodes(nodes)
    members, above = visible_members(symbols, inherits, usings, documents)
    known, seen = bind_leaves(at, symbols, inherits, usings, members, above)
    none = F.lit(None).cast("string")
    parent = at.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("p_kind"), F.col("pre").alias("p_pre"))

    # from the inside out
    first = at.join(parent, ["doc_id", "parent_id"]).filter("pre = p_pre + 1")
    last = at.filter("kind = 'IdentifierName'").join(parent, ["doc_id", "parent_id"]).filter(F.col("p_kind").isin(*ACCESSES) & (F.col("pre") > F.col("p_pre") + 1))
    access = first.filter(F.col("p_kind").isin(*ACCESSES)).select("doc_id", F.col("node_id").alias("from_id"), F.col("parent_id").alias("node_id"))
    access = checkpointed(access.join(last.select("doc_id", F.col("parent_id").alias("node_id"), F.col("text").alias("name")), ["doc_id", "node_id"]))
    called = first.filter("p_kind IN ('InvocationExpression', 'ParenthesizedExpression')").select("doc_id", F.col("node_id").alias("from_id"), F.col("parent_id").alias("node_id"))
    valued = seen.filter("type IS NULL AND value_id IS NOT NULL").select("doc_id", F.col("value_id").alias("from_id"), "node_id")
    passed = checkpointed(called.unionByName(valued))
    new = known.filter("type IS NOT NULL")
    while True:
        given = new.filter("type IS NOT NULL").select("doc_id", F.col("node_id").alias("from_id"), "type")
        asked = checkpointed(access.join(given, ["doc_id", "from_id"]).select("doc_id", "node_id", "type", "name"))
        reached = asked.join(find_members(asked, members, above), ["type", "name"]).select("doc_id", "node_id", "symbol", "kind", F.col("gives").alias("type"))
        kept = passed.join(given, ["doc_id", "from_id"]).select("doc_id", "node_id", none.alias("symbol"), none.alias("kind"), "type")
        new = checkpointed(reached.unionByName(kept))
        if new.isEmpty():
            break
        known = checkpointed(known.unionByName(new))
    # a name after a dot means what the access means; a var's own row came without a type
    tails = last.select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("tail")).join(known, ["doc_id", "node_id"]).select("doc_id", F.col("tail").alias("node_id"), "symbol", "kind", "type")
    return known.unionByName(tails).groupBy("doc_id", "node_id").agg(F.max("symbol").alias("symbol"), F.max("kind").alias("kind"), F.max("type").alias("type"))


def chain_roots(nodes: DataFrame, symbols: DataFrame, inherits: DataFrame, usings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, node_id, root_id, steps, symbol, type): of each access, call and local where its chain begins, and what stands there.

    a.b().c begins at a, and a local whose type isn't said at its first value, however many locals
    lie between. Every node points at what it is taken from, and pointers are doubled, so a chain
    of n steps takes about log2(n) rounds. inherits: bound.
    """
    at = placed_nodes(nodes)
    known, seen = bind_leaves(at, symbols, inherits, usings, *visible_members(symbols, inherits, usings, documents))
    parent = at.filter(F.col("kind").isin(*ACCESSES, "InvocationExpression", "ElementAccessExpression", "ParenthesizedExpression")).select("doc_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"))
    taken = at.select("doc_id", "node_id", "parent_id", "pre").join(parent, ["doc_id", "parent_id"]).filter("pre = p_pre + 1").select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("to"))
    first = seen.filter("type IS NULL AND value_id IS NOT NULL").select("doc_id", "node_id", F.col("value_id").alias("to"))
    links = checkpointed(taken.unionByName(first).select("doc_id", "node_id", "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    while not links.filter("moved").isEmpty():
        on = links.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        # a local in its own first value would go round; it has no root
        on = on.filter("_to != to")
        joined = links.join(on, ["doc_id", "to"], "left")
        links = checkpointed(joined.select("doc_id", "node_id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("moved")).filter("to != node_id"))
    ends = known.groupBy("doc_id", F.col("node_id").alias("to")).agg(F.max("symbol").alias("symbol"), F.max("type").alias("type"))
    return links.join(ends, ["doc_id", "to"], "left").select("doc_id", "node_id", F.col("to").alias("root_id"), "steps", "symbol", "type")


def type_refs(symbols: DataFrame, inherits: DataFrame, usings: DataFrame, documents: DataFrame) -> DataFrame:
    """The type_refs facts: bases, interfaces, fields, properties, results and parameters of each type, where the solution declares them.

    inherits: bound. An array, a tuple or a type argument is no named type of its own and gives none.
    """
    files = documents.select(F.col("file_path").alias("file"), "doc_id")
    own = symbols.filter(F.lower("kind").isin("method", "field", "property")).join(files, "file").withColumn("place", outer(F.col("display")))
    via = F.when(F.lower("kind") == "method", "return").otherwise(F.lower("kind"))
    given = own.select("place", "doc_id", "sym_ord", via.alias("via"), F.col("return_type").alias("written"))
    taken = own.filter(F.lower("kind") == "method").select("place", "doc_id", "sym_ord", F.lit("parameter").alias("via"), F.explode("params").alias("p"))
    taken = taken.select("place", "doc_id", "sym_ord", "via", F.col("p.type").alias("written"))
    found = bind_types(given.unionByName(taken), symbols, usings).filter("type IS NOT NULL").select(F.col("place").alias("src"), F.col("type").alias("dst"), "via", F.col("sym_ord").alias("ord"))
    types = symbols.filter(F.lower("kind") == "type").select(F.col("display").alias("dst")).distinct()
    based = inherits.join(types.withColumnRenamed("dst", "parent"), "parent").select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.col("rel").alias("via"), "ord")
    # members stand in types; what stands in none has none to refer from
    return found.join(types.withColumnRenamed("dst", "src"), "src", "left_semi").unionByName(based)


def _signatures(symbols: DataFrame) -> DataFrame:
    """(member, container, key): methods by name and the plain types of their parameters, properties by name."""
    types = F.transform(F.coalesce("params", F.array().cast(symbols.schema["params"].dataType)), lambda p: F.regexp_replace(F.regexp_replace(p["type"], r"\s+", ""), r"[\w.]+\.(?=\w)", ""))
    method = F.lower("kind") == "method"
    key = F.when(method, F.concat(F.col("name"), F.lit("("), F.array_join(types, ","), F.lit(")"))).otherwise(F.col("name"))
    rows = symbols.filter(F.lower("kind").isin("method", "property"))
    return rows.select(F.col("display").alias("member"), outer(F.col("display")).alias("container"), key.alias("key"), F.coalesce("is_override", F.lit(False)).alias("is_override"))


def overrides(symbols: DataFrame, inherits: DataFrame) -> DataFrame:
    """The overrides facts: each member that says so with the one that it overrides, and with those which that overrides.

    A member is met by its signature in the nearest base that has it. inherits: bound.
    """
    own = _signatures(symbols)
    above = lineage(inherits.filter("rel = 'base'"))
    base = own.select(F.col("member").alias("base_member"), F.col("container").alias("above"), "key")
    near = own.filter("is_override").join(above, F.col("container") == F.col("type")).drop("type").join(base, ["above", "key"])
    near = near.groupBy("member", "key").agg(F.min_by("base_member", F.struct("depth", "above")).alias("base_member"))
    # a chain goes on as long as each link overrides; the key keeps overloads of one display apart
    step = near.select(F.concat_ws("\0", "member", "key").alias("src"), F.concat_ws("\0", "base_member", "key").alias("dst"))
    chain = transitive_closure(step)
    return chain.select(F.split_part("src", F.lit("\0"), F.lit(1)).alias("member"), F.split_part("dst", F.lit("\0"), F.lit(1)).alias("base_member")).distinct()


def member_impl(symbols: DataFrame, inherits: DataFrame) -> DataFrame:
    """The member_impl facts: of each type and each interface above it the members that answer to the interface's, its own or the nearest base's.

    inherits: bound.
    """
    own = _signatures(symbols)
    kinds = symbols.filter(F.lower("kind") == "type").groupBy("display").agg(F.min_by("type_kind", "sym_ord").alias("shape"))
    faces = kinds.filter("shape = 'interface'").select(F.col("display").alias("above"))
    asked = lineage(inherits).join(faces, "above").join(faces.withColumnRenamed("above", "type"), "type", "left_anti").select("type", "above")
    wanted = asked.join(own.select(F.col("container").alias("above"), "key", F.col("member").alias("interface_member")), "above")
    bases = lineage(inherits.filter("rel = 'base'")).select("type", F.col("above").alias("container"), "depth")
    holders = asked.select("type").distinct().select("type", F.col("type").alias("container"), F.lit(0).alias("depth")).unionByName(bases)
    held = wanted.join(holders, "type").join(own.select("container", "key", "member"), ["container", "key"])
    best = held.groupBy("type", "interface_member", "key").agg(F.min_by("member", F.struct("depth", "container")).alias("member"))
    return best.select("member", "interface_member").distinct()
