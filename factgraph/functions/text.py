"""Predicates and scalar functions on names, paths, namespaces and severities.

All are plain columns, so Catalyst can push, prune and fold them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------

#: File names that mark generated code.
GENERATED_SUFFIXES = (
    ".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs", ".assemblyattributes.cs", ".assemblyinfo.cs", ".globalusings.g.cs",
)
#: Folders that mark generated code.
GENERATED_FOLDERS = ("/obj/", "/bin/")
#: Severities of rules, in their order.
SEVERITIES = ("info", "warning", "error")
#: Severities of diagnostics, in their order.
DIAGNOSTIC_SEVERITIES = ("hidden", "info", "warning", "error")
#: Namespaces that belong to the platform.
SYSTEM_PREFIXES = ("System", "Microsoft")
#: Endings of the names of test projects.
TEST_SUFFIXES = (".Tests", ".Test", ".UnitTests", ".IntegrationTests")
#: What may follow a type's name in the name of its test type, first match first.
TEST_TYPE_SUFFIXES = ("Tests", "Test", "_Tests", "_Test", "Specs", "Spec")

# --- names --------------------------------------------------------------------------


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, ignoring case: * any run, ? any character."""
    return "(?is)^" + "".join({"*": ".*", "?": "."}.get(c, re.sub(r"([^\w\s])", r"\\\1", c)) for c in pattern) + "$"


def name_matches(name: Column, pattern: str) -> Column:
    """Equal ignoring case, or by glob if the pattern has * or ?."""
    if is_glob(pattern):
        return name.rlike(glob_regex(pattern))
    return F.lower(name) == pattern.lower()


def contains_ignore_case(column: Column, part: str | None) -> Column:
    return F.lit(True) if not part else F.contains(F.lower(column), F.lit(part.lower()))


def equals_ignore_case(column: Column, value: str | None) -> Column:
    return F.lit(True) if not value else F.lower(column) == value.lower()


def kind_matches(kind: str | None, kind_col: str = "kind", type_kind: str = "type_kind", is_record: str = "is_record") -> Column:
    """Whether a symbol is of that kind; an unknown kind matches all."""
    wanted = (kind or "").lower()
    if wanted in ("class", "interface", "struct", "enum"):
        return (F.lower(F.col(kind_col)) == "type") & (F.lower(F.col(type_kind)) == wanted)
    if wanted == "record":
        return (F.lower(F.col(kind_col)) == "type") & F.coalesce(F.col(is_record), F.lit(False))
    if wanted in ("method", "property", "field", "event", "namespace"):
        return F.lower(F.col(kind_col)) == wanted
    return F.lit(True)


def comma_list(values: str | None) -> list[str]:
    """Split at commas, trimmed, empties dropped."""
    return [v.strip() for v in (values or "").split(",") if v.strip()]


def fuzzy_budget(name: str) -> int:
    return 2 if len(name) > 5 else 1


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein ignoring case; above `most` it is -1."""
    return F.levenshtein(F.lower(a), F.lower(b)) if most is None else F.levenshtein(F.lower(a), F.lower(b), most)


# --- paths --------------------------------------------------------------------------


def normal_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def path_ends_with(path: Column, suffix: str) -> Column:
    """Case and the direction of slashes don't matter."""
    return F.endswith(normal_path(path), F.lit(suffix.replace("\\", "/").lower()))


def path_ends_with_raw(path: Column, suffix: str) -> Column:
    """Case doesn't matter, slashes do."""
    return F.endswith(F.lower(path), F.lit(suffix.lower()))


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def is_generated_path(path: Column) -> Column:
    p = normal_path(path)
    found = F.lit(False)
    for folder in GENERATED_FOLDERS:
        found = found | F.contains(p, F.lit(folder))
    for suffix in GENERATED_SUFFIXES:
        found = found | F.endswith(F.lower(file_name(path)), F.lit(suffix))
    return F.coalesce(found, F.lit(False))


def is_generated_text(text: Column) -> Column:
    """Whether a comment before the first token holds the marker of generators."""
    head = F.regexp_extract(text, r"(?s)^((?:\s+|//[^\n]*|/\*.*?\*/|#[^\n]*)*)", 1)
    return F.coalesce(F.contains(F.lower(head), F.lit("<auto-generated")), F.lit(False))


# --- namespaces and projects ----------------------------------------------------------


def is_system_namespace(namespace: Column) -> Column:
    """By prefix alone, so `Systematic.X` counts as well; a null one counts."""
    found = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        found = found | F.startswith(namespace, F.lit(prefix))
    return F.coalesce(found, F.lit(True))


def is_test_project(project: Column) -> Column:
    found = F.lit(False)
    for suffix in TEST_SUFFIXES:
        found = found | F.endswith(F.lower(project), F.lit(suffix.lower()))
    return F.coalesce(found, F.lit(False))


def namespace_distance(a: Column, b: Column) -> Column:
    """Segments outside the common prefix, of both."""
    left, right = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    # array_position is 1-based and 0 if there is none
    first_off = F.array_position(same, False).cast("int")
    common = F.when(first_off == 0, F.size(same)).otherwise(first_off - 1)
    return F.size(left) + F.size(right) - 2 * common


def common_prefix(names: Column) -> Column:
    """Longest common prefix, in whole segments, of an array of dotted names; null if there is none."""
    parts = F.transform(names, lambda n: F.split(n, r"\."))
    shared = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.element_at(parts, 1),
        lambda acc, p: F.slice(
            acc,
            F.lit(1),
            F.aggregate(
                F.zip_with(acc, p, lambda x, y: F.coalesce(x == y, F.lit(False))),
                F.struct(F.lit(0).alias("n"), F.lit(True).alias("going")),
                lambda s, e: F.struct((s["n"] + F.when(s["going"] & e, 1).otherwise(0)).alias("n"), (s["going"] & e).alias("going")),
            )["n"],
        ),
    )
    joined = F.array_join(shared, ".")
    return F.when(joined != "", joined)


# --- severities -----------------------------------------------------------------------


def level(severity: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """The place of a severity in its order; an unknown one has the lowest."""
    out = F.lit(0)
    for i, name in enumerate(order):
        out = F.when(F.lower(severity) == name, i).otherwise(out)
    return out


def at_least(severity: Column, least: str, order: tuple[str, ...] = SEVERITIES) -> Column:
    wanted = order.index(least.lower()) if least.lower() in order else 0
    return level(severity, order) >= wanted


def is_fade_out(diagnostic_id: Column) -> Column:
    return F.endswith(diagnostic_id, F.lit("FadeOut"))


# --- code text --------------------------------------------------------------------------


def logical_lines(text: Column) -> Column:
    """Lines that are neither blank nor start with //; lines of block comments count."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1)
    return F.size(F.filter(lines, lambda x: (F.regexp_replace(x, r"^\s+|\s+$", "") != "") & ~F.ltrim(F.regexp_replace(x, r"^\s+", "")).startswith("//")))


def context_line(text: Column, line: Column) -> Column:
    """A 1-based line of a text, trimmed; null beyond its end."""
    lines = F.split(text, "\n", -1)
    return F.when((line >= 1) & (line <= F.size(lines)), F.trim(F.get(lines, line - 1)))


def reference_kind(parent: Column, grandparent: Column) -> Column:
    """What a reference does, by the kinds of the nodes above it."""
    by_parent = {
        "BaseList": "inheritance", "SimpleBaseType": "inheritance", "InvocationExpression": "invocation",
        "ObjectCreationExpression": "instantiation", "ImplicitObjectCreationExpression": "instantiation",
        "AssignmentExpression": "assignment", "TypeArgumentList": "type-argument", "Parameter": "parameter",
    }
    out = F.when(
        parent == "MemberAccessExpression",
        F.when(grandparent == "InvocationExpression", "invocation").when(grandparent == "AssignmentExpression", "assignment"),
    )
    for node, kind in by_parent.items():
        out = out.when(parent == node, kind)
    return out


def member_kind(style: str) -> Column:
    """A member's label; tools label differently: style single, batch or overview."""
    kind = F.lower(F.col("kind"))
    nested = {"single": F.lower(F.col("type_kind")), "batch": F.lit("namedtype"), "overview": F.lit("type")}[style]
    return (
        F.when((kind == "method") & (F.lower(F.col("method_kind")) == "constructor"), "constructor")
        .when(kind == "type", nested)
        .otherwise(kind)
    )


def member_type(style: str) -> Column:
    """A member's type; of events only in the single style, of nested types never."""
    kind = F.lower(F.col("kind"))
    typed = ["method", "property", "field"] + (["event"] if style == "single" else [])
    return F.when(kind.isin(typed), F.col("return_type"))
