"""One value semantics for text and typed columns.

A text column may hold numbers or dates: they are read where they are used, and what cannot be read is null,
never an error. Empty text counts as missing. Typed columns are used as they are, so that filters on them
reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
BLANKS = " \t\n\r\u000b\f"


@dataclass(frozen=True)
class Value:
    """A column and how it is read: text, int, real, time, date or other. decimals: always shown with a decimal point."""

    column: Column
    kind: str
    decimals: bool = False

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "real")

    @property
    def temporal(self) -> bool:
        return self.kind in ("time", "date")


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.DateType):
        return "date"
    return "time" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "other"


def num(v: Value) -> Column:
    """As a number; null where it is none."""
    if v.numeric:
        return v.column
    if v.kind == "text":
        return F.when(v.column.rlike(_NUMBER), v.column.try_cast("double"))
    return F.lit(None).cast("double")


def plain_number(c: Column) -> Column:
    """A double's text: whole values without a decimal point, no exponents where 15 digits do."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).otherwise(F.regexp_replace(F.format_string("%.17f", c), r"\.?0+$", ""))
    precise = F.when(text.try_cast("double") == c, text).otherwise(c.cast("string"))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(precise)


def txt(v: Value) -> Column:
    """As text; null is empty."""
    if v.kind == "text":
        out = v.column
    elif v.kind == "real":
        out = plain_number(v.column.cast("double"))
    elif v.kind == "time":
        out = F.date_format(v.column, "yyyy-MM-dd HH:mm:ss")
    else:
        out = v.column.cast("string")
    return F.coalesce(out, F.lit(""))


def is_empty(v: Value) -> Column:
    return v.column.isNull() | (v.column == "") if v.kind == "text" else v.column.isNull()


def ts(v: Value) -> Column:
    """As a timestamp in UTC, from ISO, US (/), EU (.) and compact forms; null where it is none."""
    if v.temporal:
        return v.column.cast("timestamp")
    if v.kind != "text":
        return F.lit(None).cast("timestamp")
    c = F.btrim(v.column)
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "T", " "), "Z.*$", ""), r"\.\d+$", "")

    def first(text: Column, *formats: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])

    return (
        F.when(c.contains("-"), first(iso, "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d"))
        .when(c.contains("/"), first(c, "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy"))
        .when(c.contains("."), first(c, "d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy"))
        .when(c.rlike(r"^\d{14}"), first(F.substring(c, 1, 14), "yyyyMMddHHmmss"))
        .when(c.rlike(r"^\d{8}"), first(F.substring(c, 1, 8), "yyyyMMdd"))
    )


def seconds(v: Value) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp(ts(v))
