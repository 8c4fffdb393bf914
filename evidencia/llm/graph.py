"""Union-find over tables of links, by the library's large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graphs import components


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b) but the smallest ones themselves."""
    return components(edges.select("a", "b")).withColumnsRenamed({"id": "node"})
