"""Scalar functions by name: arguments in, a value out. Built-in Column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flatsql.errors import QueryError
from flatsql.functions.kernel import BLANKS, Value, num, seconds, ts, txt
from flatsql.plans.ast import Literal

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}
PARTS = ("year", "month", "day", "hour", "minute", "second")
#: strftime codes: start and length in an ISO timestamp, and the date_format pattern.
CODES = {"Y": (1, 4, "yyyy"), "m": (6, 2, "MM"), "d": (9, 2, "dd"), "H": (12, 2, "HH"), "M": (15, 2, "mm"), "S": (18, 2, "ss")}
INTEGERS = ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT")
REALS = ("FLOAT", "DOUBLE", "REAL", "NUMERIC", "DECIMAL")
TEXTS = ("TEXT", "VARCHAR", "CHAR", "STRING", "NVARCHAR")


def _constant(arg: object, name: str) -> Literal:
    if not isinstance(arg, Literal):
        raise QueryError(f"{name} takes a literal there")
    return arg


def _number(arg: object, name: str) -> int | float:
    n = _constant(arg, name).number()
    if n is None:
        raise QueryError(f"{name} takes a number there, not {arg.value!r}")
    return n


def _whole(arg: object, name: str) -> int:
    n = _number(arg, name)
    if n != int(n):
        raise QueryError(f"{name} takes a whole number there")
    return int(n)


def as_value(arg: object) -> Value:
    if isinstance(arg, Value):
        return arg
    return Value(F.lit(arg.value), "text")


def _text(f: Callable[[Column], Column]) -> Callable:
    return lambda v: Value(f(txt(v)), "text")


def _substr(v: Value, *rest: object) -> Value:
    start = _whole(rest[0], "SUBSTR")
    text = txt(v)
    first = F.lit(max(start, 1)) if start >= 0 else F.greatest(F.length(text) + F.lit(start + 1), F.lit(1))
    length = _whole(rest[1], "SUBSTR") if len(rest) > 1 else -1
    size = F.length(text) if length < 0 else F.lit(length)
    return Value(F.substring(text, first, size), "text")


def to_whole(f: Callable[[Column], Column], x: Column) -> Column:
    """ceil or floor of a double, as a double; from 2^53 on every one is whole, and more than a bigint holds."""
    return F.when(F.abs(x) >= float(1 << 53), x).otherwise(f(x).cast("double"))


def _mod(v: Value, by: object) -> Value:
    d = _number(by, "MOD")
    if d == 0:
        return Value(F.lit(None).cast("double"), "real")
    x = num(v)
    if v.kind == "int" and isinstance(d, int):
        return Value(((x % d) + d) % d, "int")
    x = x.cast("double")
    return Value(x - to_whole(F.floor, x / d) * d, "real")


def round_to(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.round(x.cast("double") * scale) / scale


def _round(v: Value, *digits: object) -> Value:
    if not digits:
        return Value(F.round(num(v).cast("double")).try_cast("bigint"), "int")
    return Value(round_to(num(v), min(max(_whole(digits[0], "ROUND"), 0), 9)), "real")


def _coalesce(*args: object) -> Value:
    values = [as_value(a) for a in args]
    kinds = {v.kind for v in values}
    if len(kinds) == 1 and "text" not in kinds:
        return Value(F.coalesce(*[v.column for v in values]), values[0].kind)
    kept = [F.when(F.length(F.btrim(txt(v), F.lit(BLANKS))) > 0, txt(v)) for v in values]
    return Value(F.coalesce(*kept, F.lit("")), "text")


def _cast(v: Value, to: object) -> Value:
    kind = _constant(to, "CAST").value.upper()
    if kind in INTEGERS:
        return Value(num(v) if v.kind == "int" else num(v).try_cast("bigint"), "int")
    if kind in REALS:
        return Value(num(v).cast("double"), "real")
    if kind in TEXTS:
        return Value(txt(v), "text")
    raise QueryError(f"unknown type: {kind}")


def _datediff(unit: object, a: object, b: object) -> Value:
    size = UNITS.get(_constant(unit, "DATEDIFF").value.lower())
    if size is None:
        return Value(F.lit(0.0), "real")
    return Value(F.coalesce((seconds(as_value(b)) - seconds(as_value(a))) / F.lit(float(size)), F.lit(0.0)), "real")


def _dateadd(unit: object, count: object, v: object) -> Value:
    value = as_value(v)
    step = UNITS.get(_constant(unit, "DATEADD").value.lower(), 0) * _number(count, "DATEADD")
    moved = F.timestamp_seconds(seconds(value) + F.lit(int(step)))
    if value.kind == "text":  # what is no date stays as it is
        return Value(F.coalesce(F.date_format(moved, "yyyy-MM-dd HH:mm:ss"), txt(value)), "text")
    return Value(moved.cast("timestamp_ntz"), "time")


def _extract(part: object, v: object) -> Value:
    name = _constant(part, "EXTRACT").value.lower()
    if name not in PARTS:
        return Value(F.lit(0), "int")
    return Value(F.coalesce(getattr(F, "dayofmonth" if name == "day" else name)(ts(as_value(v))).cast("int"), F.lit(0)), "int")


def _strftime(form: object, v: object) -> Value:
    value, text = as_value(v), _constant(form, "STRFTIME").value
    pieces: list[Column] = []
    at = 0
    while at < len(text):
        code = CODES.get(text[at + 1 : at + 2]) if text[at] == "%" else None
        if code is None:
            pieces.append(F.lit(text[at]))
            at += 1
            continue
        start, size, pattern = code
        pieces.append(F.coalesce(F.date_format(value.column, pattern), F.lit("")) if value.temporal else F.substring(txt(value), start, size))
        at += 2
    return Value(F.concat(*pieces) if pieces else F.lit(""), "text")


def _ceil(v: Value) -> Value:
    return Value(to_whole(F.ceil, num(v).cast("double")), "real", True)


def _floor(v: Value) -> Value:
    return Value(to_whole(F.floor, num(v).cast("double")), "real", True)


#: Name: function, least and most arguments. Functions of plain values get Value objects; others see literals as such.
FUNCTIONS: dict[str, tuple[Callable, int, int]] = {
    "UPPER": (_text(F.upper), 1, 1),
    "LOWER": (_text(F.lower), 1, 1),
    "TRIM": (_text(lambda c: F.btrim(c, F.lit(BLANKS))), 1, 1),
    "LENGTH": (lambda v: Value(F.octet_length(txt(v)), "int"), 1, 1),
    "SUBSTR": (_substr, 2, 3),
    "SUBSTRING": (_substr, 2, 3),
    "ABS": (lambda v: Value(F.abs(num(v)), v.kind if v.numeric else "real"), 1, 1),
    "CEIL": (_ceil, 1, 1),
    "CEILING": (_ceil, 1, 1),
    "FLOOR": (_floor, 1, 1),
    "MOD": (_mod, 2, 2),
    "ROUND": (_round, 1, 2),
    "COALESCE": (_coalesce, 1, 256),
    "CAST": (_cast, 2, 2),
    "DATEDIFF": (_datediff, 3, 3),
    "DATEADD": (_dateadd, 3, 3),
    "EXTRACT": (_extract, 2, 2),
    "STRFTIME": (_strftime, 2, 2),
}
_LITERAL_FIRST = ("DATEDIFF", "DATEADD", "EXTRACT", "STRFTIME", "COALESCE")


def call(name: str, args: list[object]) -> Value:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function: {name}")
    function, least, most = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least if least == most else f'{least} to {most}'} arguments")
    if name not in _LITERAL_FIRST:
        args = [as_value(args[0]), *args[1:]]
    return function(*args)
