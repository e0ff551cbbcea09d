"""Aggregates over values that may be missing: sums and averages of nothing are 0, extremes are null."""

from __future__ import annotations

from pyspark.sql import functions as F

from flatsql.errors import QueryError
from flatsql.functions.kernel import Value, is_empty, num, plain_number, txt

NAMES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregate(name: str, value: Value | None, distinct: bool = False) -> Value:
    """value None is the star of COUNT(*)."""
    if distinct and name != "COUNT":
        raise QueryError(f"DISTINCT is for COUNT, not for {name}")
    if name == "COUNT":
        if value is None:
            return Value(F.count(F.lit(1)), "int")
        if distinct:  # the empty text of a text column is a value, null is none
            return Value(F.count_distinct(value.column), "int")
        return Value(F.count(F.when(~is_empty(value), F.lit(1))) if value.kind == "text" else F.count(value.column), "int")
    if value is None:
        raise QueryError(f"{name}(*) is not an aggregate")
    if name in ("SUM", "AVG"):
        total = getattr(F, name.lower())(num(value).cast("double"))
        return Value(F.coalesce(total, F.lit(0.0)), "real")
    extreme = F.min if name == "MIN" else F.max
    if value.kind == "text":  # by value if the column holds a number, else by bytes
        return Value(F.coalesce(plain_number(extreme(num(value))), extreme(F.when(~is_empty(value), txt(value)))), "text")
    return Value(extreme(value.column), value.kind)
