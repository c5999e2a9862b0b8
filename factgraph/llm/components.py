"""Connected components of an edge table, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factgraph.llm.common import written
from factgraph.operators import closure


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (a, b): the smallest id that it reaches."""
    return closure.connected_components(edges, written)
