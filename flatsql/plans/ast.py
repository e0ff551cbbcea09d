"""What a query is made of. Every expression keeps the text that it was written as."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    text: str = field(default="", compare=False, kw_only=True)


@dataclass(frozen=True)
class Literal(Expr):
    value: str

    def number(self) -> float | int | None:
        """The value as a number, whether it was quoted or not; None if it is not one. Whole ones beyond 64 bits are doubles."""
        s = self.value.strip()
        try:
            if s.lstrip("+-").isdigit() and s.isascii():
                return int(s) if -(1 << 63) <= int(s) < 1 << 63 else float(s)
            return float(s) if _NUMBER.fullmatch(s) else None
        except ValueError:
            return None


@dataclass(frozen=True)
class Name(Expr):
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: str
    fold: bool


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    items: tuple[Literal, ...]


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Literal
    high: Literal


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr


@dataclass(frozen=True)
class Logic(Expr):
    op: str
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Source:
    path: str
    alias: str | None


@dataclass(frozen=True)
class Join:
    source: Source
    left: Name
    right: Name


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    source: Source
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False


import re  # noqa: E402

_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
