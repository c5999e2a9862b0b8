"""Questions made of several others; each answer is a set of named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import inspect, metrics, navigate, rules
from factgraph.operators.graph import dependency_tree
from factgraph.operators.resolve import resolve, resolve_method
from factgraph.schema import FactSet


def analyze_method(facts: FactSet, method: str, class_name: str | None = None, depth: int = 2) -> dict[str, DataFrame]:
    """detail, callers, call_graph and complexity of a method; empty frames if there is none."""
    symbols = facts["symbols"]
    one = resolve_method(symbols, method, class_name)
    display = one.select("display")
    nodes = facts["syntax_nodes"].join(F.broadcast(display.withColumnRenamed("display", "owner_symbol")), "owner_symbol", "left_semi")  # one row
    return {
        "detail": one.select("display", "accessibility", "return_type", "params", "xml_doc", "file", "line"),
        "callers": navigate.find_callers(symbols, facts["calls"], method, class_name),
        "call_graph": dependency_tree(facts["calls"], display.withColumnRenamed("display", "id"), depth),
        "complexity": metrics.complexity(nodes),
    }


def type_overview(facts: FactSet, type_name: str, most: int = 50) -> dict[str, DataFrame]:
    """api, hierarchy, implementations (of interfaces) and the diagnostics of the first declaring file."""
    symbols = facts["symbols"]
    one = resolve(symbols.filter(F.lower("kind") == "type"), type_name)
    shape = one.filter(F.lower("type_kind") == "interface").select(F.lit(True).alias("_is"))
    below = navigate.find_implementations(symbols, facts["inherits"], type_name)
    where = one.filter("file IS NOT NULL").select(F.col("file").alias("path"))
    documents = facts["documents"] if "documents" in facts.given else None
    return {
        "api": inspect.public_api(symbols, type_name, "overview"),
        "hierarchy": navigate.type_hierarchy(symbols, facts["inherits"], type_name),
        "implementations": below.join(F.broadcast(shape), F.col("_is"), "left_semi"),  # one row or none
        "diagnostics": inspect.diagnostics(facts["diagnostics"], "file", where, documents=documents).orderBy("line", "id").limit(most),
    }


def file_overview(facts: FactSet, file: str, nodes: DataFrame, most: int = 50, most_violations: int = 100) -> dict[str, DataFrame]:
    """types, diagnostics of at least warning, and all violations of a file."""
    documents = facts["documents"] if "documents" in facts.given else None
    return {
        "types": inspect.declared_types(facts["symbols"], file),
        "diagnostics": inspect.diagnostics(facts["diagnostics"], "file", file, documents=documents).orderBy("line", "id").limit(most),
        "antipatterns": rules.detect_antipatterns(nodes, facts["pragmas"], facts["documents"], file=file, severity="info", most=most_violations),
    }


def flattened(parts: dict[str, DataFrame]) -> DataFrame:
    """The answers in one frame: (part, result), a row each as JSON."""
    from functools import reduce

    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("result")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)
