"""CSV, JSON and JSONL text of results.

Rows are pulled a partition at a time; write_csv() and write_json() leave large results to the executors.
"""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import math
import re
from collections.abc import Iterator
from typing import TextIO

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatsql.functions.kernel import Value, kind_of, txt

_JSON_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")


def render(value: object, decimals: bool = False) -> str:
    """A value's text: null is empty, whole numbers have no decimal point unless asked for, no exponents."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            return str(value)
        text = np.format_float_positional(value, trim="0" if decimals else "-")
        return "0" if text == "-0" else text
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def _decimals(df: DataFrame) -> list[bool]:
    return [bool(f.metadata.get("decimals")) for f in df.schema.fields]


def rows_as_text(df: DataFrame) -> Iterator[list[str]]:
    show = _decimals(df)
    for row in df.toLocalIterator():
        yield [render(v, d) for v, d in zip(row, show, strict=True)]


def to_csv(df: DataFrame, out: TextIO, header: bool = True, sep: str = ",") -> None:
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    for row in rows_as_text(df):
        # A lone empty field is written as nothing, as it was read.
        writer.writerow(row) if row != [""] else out.write("\n")


def _json(value: object, decimals: bool) -> str:
    text = render(value, decimals)
    if isinstance(value, bool) or _JSON_NUMBER.fullmatch(text):
        return text
    return json.dumps(text, ensure_ascii=False)


def _objects(df: DataFrame) -> Iterator[str]:
    names, show = [json.dumps(c, ensure_ascii=False) for c in df.columns], _decimals(df)
    for row in df.toLocalIterator():
        yield "{" + ",".join(f"{n}:{_json(v, d)}" for n, v, d in zip(names, row, show, strict=True)) + "}"


def to_jsonl(df: DataFrame, out: TextIO) -> None:
    for line in _objects(df):
        out.write(line + "\n")


def to_json(df: DataFrame, out: TextIO) -> None:
    out.write("[")
    first = True
    for line in _objects(df):
        out.write(("\n" if first else ",\n") + line)
        first = False
    out.write("]\n" if first else "\n]\n")


def text_of(df: DataFrame, form: str = "csv", header: bool = True, sep: str = ",") -> str:
    out = io.StringIO(newline="")
    {"csv": lambda: to_csv(df, out, header, sep), "json": lambda: to_json(df, out), "jsonl": lambda: to_jsonl(df, out)}[form]()
    return out.getvalue()


def _rendered(df: DataFrame) -> DataFrame:
    """All columns as their text."""
    out = []
    for f in df.schema.fields:
        c = txt(Value(F.col(f"`{f.name}`"), kind_of(f.dataType)))
        out.append((F.when(c.rlike(r"^-?\d+$"), F.concat(c, F.lit(".0"))).otherwise(c) if f.metadata.get("decimals") else c).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "errorifexists") -> None:
    """A folder of CSV files, written by the executors."""
    _rendered(df).write.mode(mode).csv(path, header=header, sep=sep, quote='"', escape='"', emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines, written by the executors; values keep their types."""
    df.write.mode(mode).json(path, ignoreNullFields=False)
