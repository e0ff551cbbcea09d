"""Predicates. Leaves may be null, which filters like false; NOT closes them, so that nothing is both."""

from __future__ import annotations

import datetime as dt
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flatsql.errors import QueryError
from flatsql.functions.kernel import Value, is_empty, num, ts, txt
from flatsql.plans.ast import Between, Compare, Expr, In, IsNull, Like, Literal, Logic, Not

_OPS: dict[str, Callable[[Column, object], Column]] = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def instant(text: str) -> dt.datetime | None:
    """An ISO date or timestamp as a constant, so that filters on typed columns can be pushed down."""
    try:
        return dt.datetime.fromisoformat(text.strip().replace("Z", "")) if re.match(r"\s*\d{4}-\d\d-\d\d", text) else None
    except ValueError:
        return None


def compare(op: str, left: Value, right: Value | Literal) -> Column:
    test = _OPS[op]
    if isinstance(right, Literal):
        n = right.number()
        if left.temporal and (at := instant(right.value)) is not None:
            return test(left.column, F.lit(at.isoformat(sep=" ")).cast("date" if left.kind == "date" and at.time() == dt.time() else "timestamp_ntz"))
        if n is not None and not left.temporal:
            return test(num(left), F.lit(n))
        if left.kind == "text":
            # A missing value is the empty text: only where it can fit does the column need closing.
            fits = {"=": "" == right.value, "!=": "" != right.value, ">": "" > right.value, ">=": "" >= right.value, "<": "" < right.value, "<=": "" <= right.value}[op]
            return test(txt(left) if fits else left.column, F.lit(right.value))
        return test(txt(left), F.lit(right.value))
    if left.numeric or right.numeric:
        return test(num(left), num(right))
    if left.temporal or right.temporal:
        return test(ts(left), ts(right))
    return test(txt(left), txt(right))


def like(value: Value, pattern: str, fold: bool) -> Column:
    escape = next(c for c in "\\\x01\x02\x03\x04\x05\x06\x07\x0e\x0f" if c not in pattern)
    text = value.column if value.kind == "text" and pattern.strip("%") else txt(value)
    return F.ilike(text, F.lit(pattern), F.lit(escape)) if fold else _like(text, pattern, escape)


def _like(text: Column, pattern: str, escape: str) -> Column:
    """Prefixes, suffixes and infixes as such, which reach the scan; the rest as a pattern."""
    inner = pattern.strip("%")
    if inner and not set("%_") & set(inner):
        lead, trail = pattern.startswith("%"), pattern.endswith("%")
        if trail:
            return text.contains(inner) if lead else text.startswith(inner)
        return text.endswith(inner) if lead else text == inner
    return F.like(text, F.lit(pattern), F.lit(escape))


def isin(value: Value, items: tuple[Literal, ...]) -> Column:
    texts = [i.value for i in items]
    if value.kind == "text":
        return (txt(value) if "" in texts else value.column).isin(texts)
    if value.numeric:
        numbers = [n for i in items if (n := i.number()) is not None]
        return value.column.isin(numbers) if numbers else F.lit(False)
    if value.temporal and all(instant(t) for t in texts):
        found = F.lit(False)
        for i in items:
            found = found | compare("=", value, i)
        return found
    return txt(value).isin(texts)


def predicate(expr: Expr, value: Callable[[Expr], Value]) -> Column:
    """The predicate as a Column; value() resolves what it compares."""
    inner = lambda e: predicate(e, value)
    if isinstance(expr, Logic):
        out = inner(expr.items[0])
        for item in expr.items[1:]:
            out = out & inner(item) if expr.op == "AND" else out | inner(item)
        return out
    if isinstance(expr, Not):
        if isinstance(expr.inner, IsNull):
            v = value(expr.inner.value)
            return v.column.isNotNull() & (v.column != "") if v.kind == "text" else v.column.isNotNull()
        return ~F.coalesce(inner(expr.inner), F.lit(False))
    if isinstance(expr, Compare):
        right = expr.right if isinstance(expr.right, Literal) else value(expr.right)
        return compare(expr.op, value(expr.left), right)
    if isinstance(expr, Like):
        return like(value(expr.value), expr.pattern, expr.fold)
    if isinstance(expr, In):
        return isin(value(expr.value), expr.items)
    if isinstance(expr, Between):
        v = value(expr.value)
        if v.kind == "text" and expr.low.number() is not None and expr.high.number() is None:
            return F.lit(False)
        return compare(">=", v, expr.low) & compare("<=", v, expr.high)
    if isinstance(expr, IsNull):
        return is_empty(value(expr.value))
    raise QueryError(f"not a condition: {expr.text}")
