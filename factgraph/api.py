"""All questions under their tool names, asked of one workspace of facts.

`CodeGraph(facts)` has a method for each of the 34 tools, with the defaults that users
know. Methods return DataFrames (the compound ones a dict of them); what isn't found is
an empty frame. `max_results` of the environment, if it is set, caps every frame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators import closure, compound, graph, inspect, metrics, navigate, quality, resolve, rules
from factgraph.schema import FactSet, Workspace
from factgraph.sources import csharp, discovery
from factgraph.sources.scratch import checkpointed

MAX_RESULTS_ENV = "FACTGRAPH_MAX_RESULTS"


class CodeGraph:
    def __init__(self, facts: FactSet | None = None, workspace: Workspace | None = None, env: dict[str, str] | None = None):
        if (facts is None) == (workspace is None):
            raise ValueError("either facts or a workspace")
        self.workspace, self._facts, self._parsed = workspace, facts, None
        env = os.environ if env is None else env
        self.cap = discovery.number_from(dict(env), MAX_RESULTS_ENV, 0) or None

    @property
    def facts(self) -> FactSet:
        found = self.workspace.facts if self.workspace else self._facts
        if found is None:
            raise ValueError("no solution is loaded")
        return found

    @property
    def symbols(self) -> DataFrame:
        return self.facts["symbols"]

    def _made(self, name: str) -> DataFrame:
        """A fact table that the question can't do without; an error if nobody made it."""
        self.facts.require(name)
        return self.facts[name]

    @property
    def nodes(self) -> DataFrame:
        """Rule nodes, made from the documents' texts."""
        return self._nodes()

    def _documents(self, file: str | None = None, project: str | None = None, raw: bool = False) -> DataFrame:
        """Documents of a project whose paths end so: only their texts are parsed."""
        rows = self.facts["documents"].filter(tx.contains_ignore_case(F.col("project"), project))
        ends = tx.path_ends_with_raw if raw else tx.path_ends_with
        return rows.filter(ends(F.col("file_path"), file)) if file else rows

    def _nodes(self, file: str | None = None, project: str | None = None, raw: bool = False) -> DataFrame:
        if file or project:
            nodes = csharp.rule_nodes(self._documents(file, project, raw))
        else:
            # all texts are parsed once for all that is asked of them
            if self._parsed is None or self._parsed[0] is not self.facts:
                self._parsed = self.facts, checkpointed(csharp.rule_nodes(self._documents()))
            nodes = self._parsed[1]
        return rules.with_receivers(nodes, self.facts["inherits"]) if "inherits" in self.facts.given else nodes

    def _out(self, df: DataFrame) -> DataFrame:
        return df.limit(self.cap) if self.cap else df

    def _pragmas(self, documents: DataFrame) -> DataFrame:
        return self.facts["pragmas"] if "pragmas" in self.facts.given else csharp.pragmas(documents)

    # navigation
    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        return self._out(resolve.find_symbol(self.symbols, name, kind))

    def find_references(self, symbol_name: str, file: str | None = None, line: int | None = None) -> DataFrame:
        return self._out(navigate.find_references(self.symbols, self._made("refs"), symbol_name, file, line))

    def find_implementations(self, interface_name: str) -> DataFrame:
        return self._out(navigate.find_implementations(self.symbols, self._made("inherits"), interface_name))

    def find_callers(self, method_name: str, class_name: str | None = None) -> DataFrame:
        return self._out(navigate.find_callers(self.symbols, self._made("calls"), method_name, class_name))

    def find_overrides(self, method_name: str, class_name: str | None = None) -> DataFrame:
        return self._out(navigate.find_overrides(self.symbols, self._made("overrides"), method_name, class_name))

    # inspection
    def get_public_api(self, type_name: str) -> DataFrame:
        return self._out(inspect.public_api(self.symbols, type_name))

    def get_symbol_detail(self, symbol_name: str, containing_type: str | None = None) -> DataFrame:
        return inspect.symbol_detail(self.symbols, symbol_name, containing_type)

    def get_type_hierarchy(self, type_name: str) -> DataFrame:
        return self._out(navigate.type_hierarchy(self.symbols, self._made("inherits"), type_name))

    def get_dependency_graph(self, symbol_name: str, file: str | None = None, line: int | None = None, depth: int = 3) -> DataFrame:
        root = resolve.resolve(self.symbols, symbol_name, file=file, line=line).select(F.col("display").alias("id"))
        return self._out(graph.dependency_tree(self._made("calls"), root, depth))

    # project
    def get_project_graph(self, project_filter: str | None = None, include_transitive: bool = False, max_results: int = 50) -> DataFrame:
        return self._out(graph.project_graph(self.facts["projects"], self.facts["project_refs"], project_filter, include_transitive, max_results))

    def get_diagnostics(self, scope: str = "solution", path: str | None = None, severity_filter: str = "warning", include_analyzers: bool = False) -> DataFrame:
        documents = self.facts["documents"] if "documents" in self.facts.given else None
        return self._out(inspect.diagnostics(self._made("diagnostics"), scope, path, severity_filter, include_analyzers, documents))

    def get_test_coverage_map(self, project_filter: str | None = None, max_results: int = 100) -> DataFrame:
        return self._out(quality.test_coverage_map(self.symbols, project=project_filter, most=max_results))

    # analysis
    def detect_antipatterns(self, file: str | None = None, project_filter: str | None = None, severity: str = "warning", max_results: int = 100) -> DataFrame:
        documents = self._documents(file, project_filter)
        return self._out(rules.detect_antipatterns(self._nodes(file, project_filter), self._pragmas(documents), documents, file=file, project=project_filter, severity=severity, most=max_results))

    def detect_circular_dependencies(self, scope: str = "projects", project_filter: str | None = None) -> DataFrame:
        self.facts.require("type_refs" if scope.lower() == "types" else "project_refs")
        return self._out(graph.circular_dependencies(self.facts["projects"], self.facts["project_refs"], self.facts["type_refs"], self.symbols, scope, project_filter))

    def find_dead_code(
        self, scope: str = "solution", path: str | None = None, kind: str = "all", max_results: int = 50, include_public_members: bool = False,
        include_entry_points: bool = False, project_filter: str | None = None, file_filter: str | None = None,
    ) -> DataFrame:
        found = quality.dead_code(
            self.symbols, self._made("refs"), self.facts["member_impl"], quality.framework_activated(self.symbols, self.facts["inherits"]), scope=scope, path=path, kind=kind,
            most=max_results, include_public=include_public_members, include_entry_points=include_entry_points, project_filter=project_filter, file_filter=file_filter,
        )
        return self._out(found)

    # advanced
    def get_complexity_metrics(self, name: str | None = None, scope: str = "method", class_name: str | None = None, threshold: int = 0, max_results: int = 50) -> DataFrame:
        return self._out(metrics.complexity_metrics(metrics.complexity(self._made("syntax_nodes")), self.symbols, name, scope, class_name, threshold, max_results))

    def analyze_data_flow(self, method_name: str, class_name: str | None = None) -> DataFrame:
        one = resolve.resolve_method(self.symbols, method_name, class_name).select(F.col("display").alias("method"))
        return metrics.data_flow(self._made("flow").join(F.broadcast(one), "method", "left_semi"))  # one row

    def analyze_control_flow(self, method_name: str, class_name: str | None = None) -> DataFrame:
        one = resolve.resolve_method(self.symbols, method_name, class_name).select(F.col("display").alias("method"))
        return metrics.control_flow(self._made("flow_edges").join(F.broadcast(one), "method", "left_semi"))  # one row

    def detect_duplicates(self, project_filter: str | None = None, min_statements: int = 5, max_results: int = 20) -> DataFrame:
        bodies = metrics.normalized_bodies(self._made("syntax_nodes")).join(
            self.symbols.groupBy(F.col("display").alias("owner_symbol")).agg(F.min_by("project", "sym_ord").alias("project"), F.min("sym_ord").alias("ord")), "owner_symbol"
        )
        return self._out(quality.duplicates(bodies.withColumnRenamed("owner_symbol", "display"), min_statements, max_results, project_filter))

    def resolve_external_source(self, symbol_name: str) -> DataFrame:
        return inspect.external_source(self.symbols, self.facts["documents"], symbol_name)

    # graph
    def _namespace_edges(self, project_filter: str | None) -> DataFrame:
        own = self.symbols if not project_filter else self.symbols.filter(F.contains(F.lower("project"), F.lit(project_filter.lower())))
        refs = self._made("type_refs")
        kept = refs if not project_filter else refs.join(own.select(F.col("display").alias("src")).distinct(), "src", "left_semi")
        return graph.type_edges(kept, self.symbols, by="namespace")

    def get_communities(self, project_filter: str | None = None, max_iterations: int = 20, max_results: int = 30) -> DataFrame:
        """Label, members with the highest degree first, cohesion, common prefix."""
        edges = self._namespace_edges(project_filter)
        labels = graph.communities_exact(edges, max_iterations)
        stats = graph.community_stats(labels, edges, max_results)
        degree = graph.degrees(graph.mirrored(edges)).select("id", F.col("out_degree").alias("degree"))
        listed = labels.join(degree, "id", "left").groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id"))).alias("m"))
        from factgraph.functions.text import common_prefix

        names = F.transform("m", lambda x: x["id"])
        return self._out(stats.join(listed, "label").select("label", names.alias("members"), "cohesion", common_prefix(names).alias("common_prefix")))

    def find_god_nodes(self, project_filter: str | None = None, kind: str | None = "class", threshold: float = 2.0, min_refs: int = 5, max_results: int = 20) -> DataFrame:
        return self._out(graph.god_nodes(self.symbols, self._made("refs"), threshold, min_refs, max_results, kind, project_filter))

    def find_surprising_dependencies(self, project_filter: str | None = None, max_results: int = 20) -> DataFrame:
        owners = self.symbols.select(F.col("namespace").alias("id"), "project", F.col("sym_ord").alias("ord"))
        return self._out(graph.surprising_dependencies(self._namespace_edges(project_filter), owners, max_results))

    def find_isolated_symbols(self, project_filter: str | None = None, include_public_types: bool = False, max_results: int = 50) -> DataFrame:
        return self._out(quality.isolated_symbols(self.symbols, self._made("type_refs"), self._made("refs"), include_public=include_public_types, most=max_results, project=project_filter))

    # compound
    def analyze_method(self, method_name: str, class_name: str | None = None, depth: int = 2) -> dict[str, DataFrame]:
        return compound.analyze_method(self.facts, method_name, class_name, depth)

    def get_type_overview(self, type_name: str) -> dict[str, DataFrame]:
        return compound.type_overview(self.facts, type_name)

    def get_file_overview(self, file_path: str) -> dict[str, DataFrame]:
        return compound.file_overview(self.facts, file_path, self._nodes(file_path))

    # batch
    def find_symbols_batch(self, names: str, kind: str | None = None) -> DataFrame:
        return resolve.find_symbols_batch(self.symbols, names, kind)

    def get_public_api_batch(self, type_names: str) -> DataFrame:
        return resolve.public_api_batch(self.symbols, type_names)

    def get_symbol_detail_batch(self, symbol_names: str) -> DataFrame:
        return resolve.symbol_detail_batch(self.symbols, symbol_names)

    # modular
    def _modules(self) -> DataFrame:
        if "modules" in self.facts.given:
            return self.facts["modules"]
        return graph.module_facts(self.symbols, self.facts["inherits"], self.facts["attributes"])

    def get_module_depends_on(self, module_name: str, depth: int = 3, direction: str = "dependencies") -> DataFrame:
        return self._out(graph.module_tree(self._modules(), module_name, depth, direction))

    def validate_conventions(self, project_filter: str | None = None, file: str | None = None, check_category: str = "all") -> DataFrame:
        return self._out(rules.validate_conventions(self._nodes(file, project_filter, raw=True), self._modules(), check=check_category, project=project_filter, file=file))

    validate_granit_conventions = validate_conventions

    # solution
    def list_solutions(self) -> DataFrame:
        if self.workspace is None:
            return self.facts["solutions"].select("path", "name", "is_active")
        return self.workspace.list_solutions(self.facts.spark)

    def switch_solution(self, path: str) -> FactSet:
        if self.workspace is None:
            raise ValueError("facts without a workspace have one solution")
        return self.workspace.switch_solution(path)

    def reach(self, table: str, start: str, max_depth: int | None = None) -> DataFrame:
        """(id, depth) of what a node reaches over an edge table with src and dst."""
        return closure.reachable(self.facts[table], self.facts.spark.createDataFrame([(start,)], "id string"), max_depth)
