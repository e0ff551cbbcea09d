"""Positional mode: file [columns] [where] [limit] [column[:asc|:desc]] as the same query."""

from __future__ import annotations

from collections.abc import Sequence

from flatsql.errors import QueryError
from flatsql.plans.ast import Expr, Item, Name, Order, Query, Source, Star
from flatsql.plans.parser import parse_predicate

DEFAULT_LIMIT = 10


def parse_simple(args: Sequence[str]) -> Query:
    """Missing or empty arguments take their defaults: all columns, all rows, 10 rows, no order. A limit of 0 is none."""
    if not args or len(args) > 5:
        raise QueryError("expected: file [columns] [where] [limit] [orderby]")
    path, columns, where, limit, order = [*args, "", "", "", "", ""][:5]
    names = [c.strip() for c in columns.split(",") if c.strip()]
    items = tuple(Item(Name(c, text=c), None) for c in names) if names and names != ["*"] else (Item(Star(text="*"), None),)
    if limit.strip() and not limit.strip().isdigit():
        raise QueryError(f"the limit must be a whole number, not {limit!r}")
    rows = int(limit) if limit.strip() else DEFAULT_LIMIT
    predicate: Expr | None = parse_predicate(where) if where.strip() else None
    return Query(items, Source(path, None), where=predicate, order_by=_order(order), limit=rows or None)


def _order(text: str) -> tuple[Order, ...]:
    if not text.strip():
        return ()
    name, _, direction = text.strip().partition(":")
    if direction.lower() not in ("", "asc", "desc"):
        raise QueryError(f"order is asc or desc, not {direction!r}")
    return (Order(Name(name, text=name), direction.lower() == "desc"),)
