"""Ordered pattern rules, as column expressions and as DuckDB SQL.

A rule list is data; ``any_of`` and ``first_of`` turn it into a Spark column, ``any_sql`` and
``first_sql`` into the SQL that the twins use. Patterns keep to what Java and RE2 both read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(value: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; false for null."""
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(p)
    return F.coalesce(found, F.lit(False))


def any_sql(value: str, patterns: list[str]) -> str:
    return "coalesce(" + " or ".join(f"regexp_matches({value}, {quoted(p)})" for p in patterns) + ", false)"


def first_of(rules: list[tuple[Column, str | Column | None]], other: str | Column | None = None) -> Column:
    """The text of the first condition that holds."""
    as_column = lambda t: t if isinstance(t, Column) else F.lit(t).cast("string")
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), as_column(rules[0][1]))
    for condition, text in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), as_column(text))
    return out.otherwise(as_column(other))


def first_sql(rules: list[tuple[str, str]], other: str = "null") -> str:
    """``rules``: condition and result, both SQL."""
    return "case " + " ".join(f"when {c} then {t}" for c, t in rules) + f" else {other} end"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
