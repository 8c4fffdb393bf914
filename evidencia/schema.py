"""Enumerations of the evidence graph and their orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names in rank order (fixed values).
GAP_EVIDENCE = ["none", "weak", "covered"]
LAYERS = ["unit", "component", "integration", "api", "e2e", "manual", "unknown"]
TIERS = ["proven", "runtime", "associated", "candidate", "none"]
STATUSES = ["No integration signal", "Candidate signal (unconfirmed)", "Associated signal", "Generated-unverifiable", "Runtime-covered", "Proven", "Reproven (this run)"]
BEHAVIORS = ["Requirement", "UserFlow", "BusinessRule"]
HARD_TYPES = ["TESTED_BY", "COVERS"]
WEAK_TYPES = ["MAY_BE_TESTED_BY", "MAY_COVER"]
SIGNAL_TYPES = ["MAY_RELATE_TO", *WEAK_TYPES]


def rank_of(value: Column, names: list[str]) -> Column:
    """A name's place in its order; after all for others."""
    out = F.when(value == names[0], 0)
    for i, name in enumerate(names[1:], 1):
        out = out.when(value == name, i)
    return out.otherwise(len(names))
