"""Filter dicts as columns: nested and/or, comparisons, containment, payload maps and tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "gt": lambda c, v: c > v, ">": lambda c, v: c > v, "gte": lambda c, v: c >= v, ">=": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "<": lambda c, v: c < v, "lte": lambda c, v: c <= v, "<=": lambda c, v: c <= v,
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: F.contains(c, F.lit(v)), "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v), "like": lambda c, v: c.like(f"%{v}%"),
}


def _both(conditions: Sequence[Column], join) -> Column:
    return reduce(join, conditions) if conditions else F.lit(True)


def condition(spec: Mapping[str, Any]) -> Column:
    """`{"and": [...]}`, `{"or": [...]}` or `{field: value | list | {operator: value}}`, all of which must hold.

    An empty spec holds for every row; an unknown operator raises ValueError. A list means any of its
    values. Comparisons with null hold for no row.
    """
    parts = []
    for key, value in spec.items():
        if key in ("and", "or"):
            parts.append(_both([condition(s) for s in value], and_ if key == "and" else or_))
        elif isinstance(value, Mapping):
            for name, operand in value.items():
                if name not in COMPARISONS:
                    raise ValueError(f"unknown operator {name!r}")
                column = F.col(key)
                if key.endswith("_at") or key == "ts":
                    operand = F.lit(operand).cast("timestamp")
                parts.append(COMPARISONS[name](column, operand))
        elif isinstance(value, (list, tuple, set)):
            parts.append(F.col(key).isin(*value))
        else:
            parts.append(F.col(key) == value)
    return F.coalesce(_both(parts, and_), F.lit(False))


def payload_matches(payload: Column, spec: Mapping[str, Any]) -> Column:
    """Whether a map of strings meets a filter: a missing key never does, a list means any, an empty filter always holds."""
    parts = []
    for key, value in spec.items():
        found = F.try_element_at(payload, F.lit(key))
        parts.append(found.isin(*map(str, value)) if isinstance(value, (list, tuple, set)) else found == str(value))
    return F.coalesce(_both(parts, and_), F.lit(False))


def tags_any(tags: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def tags_all(tags: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def wanted_values(value: str | Sequence[str] | None) -> list[str] | None:
    """A list or comma string to trimmed values that are not empty; None where nothing is left."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return [p.strip() for p in map(str, parts) if p.strip()] or None
