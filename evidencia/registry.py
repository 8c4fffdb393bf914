"""Named queries: a function of the graph, and the SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.driver_tables import Graph, with_clause

BUILDERS: dict[str, Callable[[Graph], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, relations: tuple[str, ...] | str = (), sql: str | None = None):
    """Registers a function of a Graph. ``sql`` may begin with further common table expressions."""
    relations = (relations,) if isinstance(relations, str) else relations

    def registered(f: Callable[[Graph], DataFrame]):
        BUILDERS[name] = f
        if sql is not None:
            head = with_clause(*relations).replace("with ", "with recursive ", 1) if relations else ""
            ORACLES[name] = f"{head} {sql.strip()}"
        return f

    return registered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for name, f in BUILDERS.items()}
