"""All named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from . import registry
from .operators import answers, barrels, calls, classification, coverage, evidence, graphs, imports, ledger, merge, scripts, selection, symbols, tallies, text  # noqa: F401  each registers its queries
from .plans import doctor, flows, reports, risk, system_map, traceability  # noqa: F401
from .streaming import telemetry  # noqa: F401


def queries():
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
