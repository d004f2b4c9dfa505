"""Predicates, IF/THEN/ELSE and value maps with fixed null rules.

``==`` and the ordered comparisons are false on null, ``!=`` is true on null, and ``not isin`` keeps nulls.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

Value = str | int | float | None


def typed(literal: str) -> Value:
    """Text typed as int, else float, else string."""
    for kind in (int, float):
        try:
            return kind(literal)
        except ValueError:
            continue
    return literal


def predicate(col: str, op: str, value: str = "") -> Column:
    c = F.col(col)
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    if op in ("isin", "not isin"):
        members = [v.strip() for v in value.split(",")]
        text = F.coalesce(c.cast("string"), F.lit("nan"))
        return text.isin(members) if op == "isin" else ~text.isin(members)
    if op == "contains":
        return F.coalesce(c.cast("string").rlike(value), F.lit(False))
    if op == "startswith":
        return F.coalesce(c.cast("string").startswith(value), F.lit(False))
    if op == "endswith":
        return F.coalesce(c.cast("string").endswith(value), F.lit(False))
    lit = typed(value)
    if op in ("==", "!="):
        same = (c.try_cast("double").eqNullSafe(F.lit(float(lit))) if isinstance(lit, (int, float))
                else c.cast("string").eqNullSafe(F.lit(lit)))
        return same if op == "==" else ~same
    x = c.try_cast("double")
    bound = F.lit(float(lit)) if isinstance(lit, (int, float)) else F.lit(None).cast("double")
    compare = {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}
    if op not in compare:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(compare[op], F.lit(False))


def combine(conditions: list[Column], how: str = "AND") -> Column:
    return reduce(and_ if how.upper() == "AND" else or_, conditions)


def branch(value: Value | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def if_else(mask: Column, then: Value | Column, otherwise: Value | Column) -> Column:
    """``then`` where the mask holds, else ``otherwise`` (also where the mask is null)."""
    return F.when(mask, branch(then)).otherwise(branch(otherwise))


def parse_map(text: str) -> dict[str, str]:
    """``"a:1, b:2"`` to a dictionary."""
    pairs = [p.split(":", 1) for p in text.split(",") if ":" in p]
    return {k.strip(): v.strip() for k, v in pairs}


def map_values(col: str, mapping: dict[str, Value]) -> Column:
    """Looked-up value, null when the value is not in the map."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), F.col(col).cast("string"))
