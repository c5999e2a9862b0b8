"""What a type, a symbol or a file consists of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators.resolve import resolve


def public_members(symbols: DataFrame, style: str = "single") -> DataFrame:
    """Public members of all types, without implicit ones and accessors: container, name, kind, signature, return_type."""
    accessors = ("propertyget", "propertyset", "eventadd", "eventremove")
    rows = symbols.filter(
        (F.lower("accessibility") == "public")
        & ~F.coalesce(F.col("is_implicit"), F.lit(False))
        & F.col("container").isNotNull()
        & ~F.coalesce(F.lower("method_kind").isin(*accessors), F.lit(False))
    )
    return rows.select(
        "container", "name", tx.member_kind(style).alias("kind"), F.col("display").alias("signature"), tx.member_type(style).alias("return_type"), "sym_ord"
    )


def public_api(symbols: DataFrame, type_name: str, style: str = "single") -> DataFrame:
    """The public members of one type, in their order. An unknown type has none."""
    types = resolve(symbols.filter(F.lower("kind") == "type"), type_name).select(F.col("display").alias("container"))
    return public_members(symbols, style).join(F.broadcast(types), "container").orderBy("sym_ord").drop("sym_ord")


def symbol_detail(symbols: DataFrame, name: str, containing_type: str | None = None) -> DataFrame:
    """The first symbol of that name with its parameters, type and documentation."""
    rows = symbols if not containing_type else symbols.filter(tx.equals_ignore_case(F.col("container_name"), containing_type))
    return resolve(rows, name).select("display", F.lower("kind").alias("kind"), "accessibility", "return_type", "params", "xml_doc", "file", "line")


def declared_types(symbols: DataFrame, file: str | None = None) -> DataFrame:
    """Types that files declare: file, display, kind (class, interface, struct, record, record struct, enum), line."""
    rows = symbols.filter(F.lower("kind") == "type")
    if file:
        rows = rows.filter(tx.path_ends_with(F.col("file"), file))
    record, shape = F.coalesce(F.col("is_record"), F.lit(False)), F.lower("type_kind")
    kind = F.when(record & (shape == "struct"), "record struct").when(record, "record").otherwise(shape)
    return rows.filter(shape.isin("class", "interface", "struct", "enum") | record).select("file", "display", kind.alias("kind"), "line", "sym_ord").orderBy("sym_ord").drop("sym_ord")


def document_at(documents: DataFrame, path: str | DataFrame) -> DataFrame:
    """(project, file): the first document, in the order of projects and files, whose path ends so.

    path: a path, or a table (path) of at most one row; without a row there is no document.
    """
    rows = documents.select("project", F.col("file_path").alias("file"), F.col("doc_ord").alias("_o"), tx.normal_path(F.col("file_path")).alias("_p"))
    if isinstance(path, DataFrame):
        one = path.select(tx.normal_path(F.col("path")).alias("_end"))
        rows = rows.join(F.broadcast(one), F.endswith("_p", F.col("_end")))  # one row
    else:
        rows = rows.filter(F.endswith("_p", F.lit(path.replace("\\", "/").lower())))
    return rows.orderBy("_o", "project", "file").limit(1).select("project", "file")


def diagnostics(
    rows: DataFrame, scope: str = "solution", path: str | DataFrame | None = None, severity: str = "warning", include_analyzers: bool = False,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Diagnostics of at least a severity, in a file, a project or everywhere; faded-out ones never.

    For a file those of one document count: the first, in the order of projects and
    files, whose path ends so, be it without any diagnostics. Without `documents` the
    files that have some are all that is known, and they are taken in the order of names.
    """
    found = rows.filter(tx.at_least(F.col("severity"), severity, tx.DIAGNOSTIC_SEVERITIES) & ~F.coalesce(tx.is_fade_out(F.col("id")), F.lit(False)))
    if not include_analyzers:
        found = found.filter(F.coalesce(F.col("source"), F.lit("compiler")) == "compiler")
    if scope.lower() == "file":
        known = documents if documents is not None else rows.select("project", F.col("file").alias("file_path"), F.lit(0).alias("doc_ord"))
        one = document_at(known, path if path is not None else "\x00").select(F.col("project").alias("_project"), F.col("file").alias("_file"))
        here = F.col("project").eqNullSafe(F.col("_project")) & F.col("file").eqNullSafe(F.col("_file"))
        return found.join(F.broadcast(one), here, "left_semi")  # one row
    if scope.lower() == "project":
        return found.filter(tx.equals_ignore_case(F.col("project"), path))
    return found


def external_source(symbols: DataFrame, documents: DataFrame, name: str, lines: int = 60) -> DataFrame:
    """Where a symbol's source lies, and its first lines: display, source, file, text.

    Only source facts are known here; decompiling an assembly is not this engine's work.
    """
    found = resolve(symbols, name).select("display", "file")
    texts = documents.select(F.col("file_path").alias("file"), "text")
    return found.join(texts, "file", "left").select(
        "display", F.when(F.col("file").isNotNull(), "sourcelink").otherwise("none").alias("source"), "file",
        F.array_join(F.slice(F.split("text", "\n", -1), 1, lines), "\n").alias("text"),
    )


def method_body(symbols: DataFrame, documents: DataFrame, nodes: DataFrame, method: str, class_name: str | None = None) -> DataFrame:
    """The nodes of a method's body, in the document of its first declaration: display, project, doc_id, node_id, kind, pre.

    A body is a block or an arrow expression. A method without one, or in a file that no project holds, has no rows.
    """
    from factgraph.operators.resolve import resolve_method

    one = resolve_method(symbols, method, class_name).select("display", tx.normal_path(F.col("file")).alias("_path"))
    owners = documents.select("doc_id", "project", "doc_ord", tx.normal_path(F.col("file_path")).alias("_path"))
    where = owners.join(F.broadcast(one), "_path").orderBy("doc_ord").limit(1)
    own = nodes.join(F.broadcast(where.select("doc_id", "project", "display")), "doc_id").filter(F.col("owner_symbol") == F.col("display"))
    body = own.filter(F.col("kind").isin("Block", "ArrowExpressionClause")).groupBy("doc_id").agg(F.min_by(F.struct(F.col("pre").alias("a"), F.col("post").alias("b")), "pre").alias("s"))
    return own.join(F.broadcast(body), "doc_id").filter(F.col("pre").between(F.col("s.a"), F.col("s.b"))).select("display", "project", "doc_id", "node_id", "kind", "pre")
