"""References, callers, overrides, implementations and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators.closure import reachable
from factgraph.operators.resolve import resolve, resolve_method


def find_references(symbols: DataFrame, refs: DataFrame, name: str, file: str | None = None, line: int | None = None) -> DataFrame:
    """Every reference to the symbol that a name means: file, line, kind, context. file and line only choose the symbol."""
    one = resolve(symbols, name, file=file, line=line).select(F.col("display").alias("symbol"))
    return refs.join(F.broadcast(one), "symbol").select(
        "symbol", "file", "line", tx.reference_kind(F.col("parent_kind"), F.col("grandparent_kind")).alias("kind"), F.trim("context").alias("context")
    )


def find_callers(symbols: DataFrame, calls: DataFrame, method: str, class_name: str | None = None) -> DataFrame:
    """Direct callers of a method, each once."""
    one = resolve_method(symbols, method, class_name).select(F.col("display").alias("callee"))
    callers = calls.join(F.broadcast(one), "callee").groupBy("caller").agg(F.count("*").alias("calls"))
    return callers.join(symbols.select(F.col("display").alias("caller"), "file", "line"), "caller", "left")


def find_overrides(symbols: DataFrame, overrides: DataFrame, method: str, class_name: str | None = None) -> DataFrame:
    one = resolve_method(symbols, method, class_name).select(F.col("display").alias("base_member"))
    found = overrides.join(F.broadcast(one), "base_member").select(F.col("member").alias("display"))
    return found.join(symbols.select("display", "file", "line"), "display", "left")


def find_implementations(symbols: DataFrame, inherits: DataFrame, name: str) -> DataFrame:
    """Types below a type at any distance. The name is tried as an interface first, fuzzy search included."""
    as_interface = resolve(symbols.filter(tx.kind_matches("interface")), name).select("display", F.lit(0).alias("_rank"))
    as_any = resolve(symbols.filter(F.lower("kind") == "type"), name).select("display", F.lit(1).alias("_rank"))
    one = as_interface.unionByName(as_any).orderBy("_rank").limit(1).select(F.col("display").alias("id"))
    edges = inherits.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    below = reachable(edges, one).filter("depth > 0").groupBy(F.col("id").alias("display")).agg(F.min("depth").alias("depth"))
    return below.join(symbols.select("display", "file", "line"), "display", "left")


def type_hierarchy(symbols: DataFrame, inherits: DataFrame, name: str, root: str = "object") -> DataFrame:
    """display, relation (base, interface or derived) and distance. The root of all types is left out."""
    one = resolve(symbols.filter(F.lower("kind") == "type"), name).select(F.col("display").alias("id"))
    up = inherits.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "rel")
    bases = reachable(up.filter("rel = 'base'").select("src", "dst"), one).filter((F.col("depth") > 0) & (F.col("id") != root))
    # interfaces: from the type and its bases, over any edge, those entered by an interface edge
    above = reachable(up.select("src", "dst"), one)
    interfaces = above.filter("depth > 0").join(up.filter("rel = 'interface'").select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    down = inherits.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    derived = reachable(down, one).filter("depth > 0")
    out = None
    for df, relation in ((bases, "base"), (interfaces, "interface"), (derived, "derived")):
        part = df.select(F.col("id").alias("display"), F.lit(relation).alias("relation"), "depth")
        out = part if out is None else out.unionByName(part)
    return out
