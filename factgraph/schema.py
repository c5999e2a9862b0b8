"""Column contracts of the fact tables, and the set of them that operators run on."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PARAMS = "array<struct<name: string, type: string, has_default: boolean, default_value: string>>"

#: Each fact table's columns, as a DDL string. Every table has an ordinal where the order of scanning matters.
CONTRACTS: dict[str, str] = {
    "solutions": "path string, name string, depth int, is_active boolean",
    "projects": "project string, file_path string, target_framework string, assembly string, ord long",
    "project_refs": "src string, dst string, ord long",
    "documents": "doc_id long, project string, file_path string, text string, doc_ord long",
    "symbols": (
        "display string, name string, kind string, type_kind string, method_kind string, is_record boolean, accessibility string,"
        " container string, container_name string, container_accessibility string, namespace string, assembly string, project string,"
        f" file string, line int, return_type string, is_override boolean, is_implicit boolean, params {_PARAMS},"
        " attributes array<string>, xml_doc string, sym_ord long"
    ),
    "inherits": "child string, parent string, rel string, ord long",
    "member_impl": "member string, interface_member string",
    "overrides": "member string, base_member string",
    "type_refs": "src string, dst string, via string, ord long",
    "refs": "symbol string, file string, line int, parent_kind string, grandparent_kind string, context string",
    "calls": "caller string, callee string, ord long",
    "syntax_nodes": "doc_id long, node_id int, parent_id int, pre int, post int, depth int, kind string, text string, line int, owner_symbol string",
    "pragmas": "doc_id long, line int, action string, code string",
    "attributes": "owner string, name string, arg_kind string, arg_text string, pos int",
    "modules": "module string, project string, dep string, pos int, file string, line int, strict boolean",
    "diagnostics": "project string, file string, line int, id string, severity string, message string, source string",
    "flow": "method string, variable string, role string",
    "flow_edges": "method string, src int, dst int, kind string",
}


def contract(name: str) -> T.StructType:
    return T.StructType.fromDDL(CONTRACTS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in a table's contract: columns in order and type; missing ones null, others dropped."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in contract(name)])


class FactSet(Mapping):
    """Named fact tables, or functions that make them when they are first asked for. Operators read only those that they need."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self.given, self.made = dict(tables or {}), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in CONTRACTS:
            raise KeyError(name)
        if name not in self.given:
            return self.spark.createDataFrame([], contract(name))
        if name not in self.made:
            table = self.given[name]
            self.made[name] = conform(table() if callable(table) else table, name)
        return self.made[name]

    def __iter__(self):
        return iter(CONTRACTS)

    def __len__(self) -> int:
        return len(CONTRACTS)

    @property
    def tables(self) -> dict[str, DataFrame]:
        """Those that were given."""
        return {name: self[name] for name in self.given}

    def require(self, *names: str) -> None:
        """An error if a table was not given: what no front end made isn't the same as an empty one."""
        missing = [n for n in names if n not in self.given]
        if missing:
            raise ValueError(f"no fact table {', '.join(missing)}: derive them (facts_from_texts, operators.binding) or give empty ones")

    def cached(self, *names: str) -> FactSet:
        for name in names:
            self.made[name] = self[name].cache()
        return self

    def release(self) -> None:
        """Gives back what cached() holds."""
        for table in self.made.values():
            table.unpersist()

    def write(self, path: str, partition_by: Mapping[str, str] | None = None) -> None:
        """Each table as Parquet below path, partitioned where given, so filters on a project prune."""
        for name, df in self.tables.items():
            out = df.write.mode("overwrite")
            if name in (partition_by or {}):
                out = out.partitionBy(partition_by[name])
            out.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: tuple[str, ...] = tuple(CONTRACTS), format: str = "parquet") -> FactSet:
        """Tables that any front end wrote, as Parquet, or as JSON, ORC or CSV by their contracts; nothing is inferred."""
        return cls(spark, {n: spark.read.schema(contract(n)).format(format).load(f"{path}/{n}") for n in names})


def least_recently_used(accesses: DataFrame, capacity: int, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, last_access) of what a store of `capacity` entries gives up, longest unused first."""
    from pyspark.sql import functions as F

    last = accesses.groupBy(key).agg(F.max(order).alias("last_access"))
    held = last.orderBy(F.desc("last_access"), key).limit(capacity).select(key)
    return last.join(held, key, "left_anti").orderBy("last_access", key)


class Workspace:
    """The active fact set of several solutions; loading one keeps the old one on failure."""

    def __init__(self, load: Callable[[str], FactSet], paths: list[str], active: str | None = None):
        self.load, self.paths, self.active = load, list(paths), active
        self.facts = load(active) if active else None

    def list_solutions(self, spark: SparkSession) -> DataFrame:
        """(path, name, is_active) of the solutions that were found."""
        rows = [(p, p.replace("\\", "/").rsplit("/", 1)[-1], p.lower() == (self.active or "").lower()) for p in self.paths]
        return spark.createDataFrame(rows, "path string, name string, is_active boolean")

    def switch_solution(self, path: str) -> FactSet:
        """Binds the facts of a listed solution; an unlisted path or a failed load changes nothing."""
        found = next((p for p in self.paths if p.lower() == path.lower()), None)
        if found is None:
            raise ValueError(f"not a listed solution: {path}")
        facts = self.load(found)
        self.active, self.facts = found, facts
        return facts
