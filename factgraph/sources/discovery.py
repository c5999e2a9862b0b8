"""Solutions and projects in folders, read through Spark's own file sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------

SKIPPED_FOLDERS = (".git", ".vs", ".idea", "node_modules", "bin", "obj", "packages", "artifacts", "TestResults", ".claude", "nupkgs")
DEEPEST = 3
SOLUTION_ENV = "FACTGRAPH_SOLUTION"
DEFAULTS = {"timeout": 30, "max_results": 100, "cache_size": 20, "log_level": "Information"}


def number_from(env: dict[str, str], name: str, default: int) -> int:
    """A positive number of the environment, else the default."""
    try:
        value = int(env.get(name, "").strip())
    except ValueError:
        return default
    return value if value > 0 else default


def find_solutions(paths: DataFrame, root: str, deepest: int = DEEPEST) -> DataFrame:
    """(path, depth) of .sln and .slnx files, shallowest first, then by path ignoring case.

    paths: (path). Files below a skipped folder or deeper than `deepest` don't count.
    """
    below = F.regexp_replace(F.substr(F.translate("path", "\\", "/"), F.lit(len(root.rstrip("/")) + 1)), "^/+", "")
    parts = F.split(below, "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower)
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(s.lower()) for s in SKIPPED_FOLDERS]))
    found = paths.filter(F.startswith(F.translate("path", "\\", "/"), F.lit(root.rstrip("/") + "/")) & F.lower("path").rlike(r"\.slnx?$"))
    return found.select("path", (F.size(parts) - 1).alias("depth"), skipped.alias("_s")).filter(~F.coalesce("_s", F.lit(False)) & (F.col("depth") <= deepest)).drop("_s").orderBy("depth", F.lower("path"))


def best_solution(paths: DataFrame, root: str) -> DataFrame:
    return find_solutions(paths, root).limit(1)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of files below a root; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def solution_path(spark: SparkSession, args: list[str], env: dict[str, str] | None = None, cwd: str | None = None) -> str | None:
    """--solution or -s, else the environment (blank: unset), else the best match below the working folder; a folder is searched."""
    env = os.environ if env is None else env
    given = next((args[i + 1] for i, a in enumerate(args[:-1]) if a in ("--solution", "-s")), None) or (env.get(SOLUTION_ENV, "").strip() or None)
    where = given or cwd or os.getcwd()
    if where.lower().endswith((".sln", ".slnx")):
        return where
    row = best_solution(list_files(spark, where, "*.sln*"), where).first()
    return row["path"] if row else None


def solution_projects(texts: DataFrame) -> DataFrame:
    """(path, project, project_path, ord) from the texts of .sln and .slnx files."""
    classic = F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'), F.lit(1))
    xml = F.regexp_extract_all("text", F.lit(r'<Project\s[^>]*Path="([^"]+\.csproj)"'), F.lit(1))
    found = texts.select("path", F.posexplode(F.when(F.endswith(F.lower("path"), F.lit(".slnx")), xml).otherwise(classic)).alias("ord", "project_path"))
    return found.withColumn("project_path", F.translate("project_path", "\\", "/")).withColumn("project", F.regexp_replace(F.substring_index("project_path", "/", -1), r"(?i)\.csproj$", ""))


def project_files(texts: DataFrame) -> DataFrame:
    """(project, file_path, target_framework, refs) from project files (path, text), by an XML reader.

    The framework is the first that is named, one alone before several. Comments say
    nothing, conditions aren't evaluated. What isn't well-formed XML has nulls, no references too.
    """
    item = "ARRAY<STRUCT<_Include: STRING>>"
    framework = "ARRAY<STRUCT<_VALUE: STRING, _Condition: STRING>>"
    schema = f"PropertyGroup ARRAY<STRUCT<TargetFramework: {framework}, TargetFrameworks: {framework}>>, ItemGroup ARRAY<STRUCT<ProjectReference: {item}>>, _broken STRING"
    # a byte order mark is no part of the document; elements may stand in the old default namespace
    read = F.from_xml(F.regexp_replace("text", "^\ufeff", ""), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true"})
    found = texts.select("path", F.when(F.trim("text") != "", read).alias("x")).withColumn("x", F.when(F.col("x._broken").isNull(), F.col("x")))
    groups = F.filter(F.coalesce("x.PropertyGroup", F.array().cast(f"ARRAY<STRUCT<TargetFramework: {framework}, TargetFrameworks: {framework}>>")), lambda g: g.isNotNull())
    one = lambda tag: F.trim(F.get(F.flatten(F.filter(F.transform(groups, lambda g: g[tag]), lambda f: f.isNotNull())), F.lit(0))["_VALUE"])
    items = F.flatten(F.filter(F.transform("x.ItemGroup", lambda g: g["ProjectReference"]), lambda r: r.isNotNull()))
    name = lambda p: F.regexp_replace(F.substring_index(F.translate(p, "\\", "/"), "/", -1), r"(?i)\.csproj$", "")
    refs = F.transform(F.filter(F.coalesce(items, F.array().cast(item)), lambda r: r["_Include"].isNotNull()), lambda r: name(r["_Include"]))
    return found.select(
        name(F.col("path")).alias("project"), F.col("path").alias("file_path"), F.coalesce(one("TargetFramework"), one("TargetFrameworks")).alias("target_framework"),
        F.when(F.col("x").isNotNull(), refs).alias("refs"),
    )


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text"))


def text_lines(texts: DataFrame) -> DataFrame:
    """(path, line, text): a row a line, counted from 1."""
    return texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), F.rtrim(F.regexp_replace("text", "\r$", "")).alias("text"))


def to_json(df: DataFrame, column: str = "result") -> DataFrame:
    """One JSON string a row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def markdown_report(rows: list, columns: list[str], title: str) -> str:
    """A small table of results as Markdown, made on the driver."""
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows]) + "\n"
