"""CSV and its like as DataFrames of text columns: header first, quotes doubled, missing values empty."""

from __future__ import annotations

import atexit
import contextlib
import csv
import io
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flatsql.errors import QueryError

_ESCAPES = {r"\t": "\t", r"\n": "\n", r"\r": "\r", r"\|": "|", r"\;": ";"}


def delimiter(text: str) -> str:
    out = _ESCAPES.get(text, text)
    if len(out) != 1:
        raise QueryError(f"a delimiter is one character, not {text!r}")
    return out


def _schema(header: list[str], path: str) -> T.StructType:
    names = [h.removeprefix("﻿") if i == 0 else h for i, h in enumerate(header)]
    if len({n.lower() for n in names}) < len(names):
        raise QueryError(f"{path} has columns of the same name")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _filled(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c.replace('`', '``')}`"), F.lit("")).alias(c) for c in df.columns])


def _breaks_in_quotes(df: DataFrame) -> bool:
    return not df.where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """A file, folder or pattern. Short rows are filled, long ones cut, blank lines skipped.

    multiline: whether quoted fields may hold line breaks, at the price of files that are not split. None looks
    for lines with an odd number of quotes in the whole input, in one distributed scan; False takes it that they do not.
    """
    sep = delimiter(sep)
    lines = spark.read.text(path)
    first = next((r[0] for r in lines.where(F.length(F.trim("value")) > 0).take(1)), None)
    if first is None:
        raise QueryError(f"{path} is empty")
    schema = _schema(next(csv.reader([first], delimiter=sep)), path)
    if multiline is None:
        multiline = _breaks_in_quotes(lines)
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", enforceSchema=True, maxCharsPerColumn=-1)
    return _filled(df)


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """The path and its file system, whatever its scheme."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, of all files of a folder, or of what a pattern names."""
    target, files = hadoop_path(spark, path)
    return sum(files.getContentSummary(found.getPath()).getLength() for found in files.globStatus(target) or ())


def spool(spark: SparkSession, parts: Iterable[str]) -> str:
    """A text written piece by piece to a file that all workers can read, until the application ends; its path."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        folder = f"file://{tempfile.gettempdir()}" if local else spark.conf.get("spark.sql.warehouse.dir")
    target, files = hadoop_path(spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.csv")
    out = files.create(target)
    for part in parts:
        out.write(bytearray(part.encode("utf-8", "surrogateescape")))
    out.close()

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            files.delete(target, False)

    atexit.register(remove)
    return target.toString()


def read_piped(spark: SparkSession, stdin: TextIO, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """Standard input, of any length: the driver holds a piece of it at a time."""

    def parts() -> Iterator[str]:
        while part := stdin.read(1 << 20):
            yield part

    return read_csv(spark, spool(spark, parts()), sep, multiline)


def read_lines(spark: SparkSession, lines: Iterable[str], sep: str = ",") -> DataFrame:
    """Captured text that the driver holds, as a DataFrame."""
    rows = [r for r in csv.reader(lines, delimiter=delimiter(sep)) if r]
    if not rows:
        raise QueryError("the input is empty")
    schema = _schema(rows[0], "the input")
    width = len(schema)
    return spark.createDataFrame([tuple((r + [""] * width)[:width]) for r in rows[1:]], schema)


def read_text(spark: SparkSession, text: str, sep: str = ",") -> DataFrame:
    return read_lines(spark, io.StringIO(text, newline=""), sep)


def profile(df: DataFrame) -> list[dict[str, object]]:
    """For every column: index, name, type (INTEGER, FLOAT, TEXT), filled, empty and all rows; one pass over the data."""
    integer, real = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts += [F.count(F.when(text != "", 1)).alias(f"f{i}"), F.count(F.when(text.rlike(integer), 1)).alias(f"i{i}"), F.count(F.when(text.rlike(real), 1)).alias(f"r{i}")]
    found = df.agg(*parts).first()
    out = []
    for i, c in enumerate(df.columns):
        filled = found[f"f{i}"]
        kind = "TEXT" if not filled else "INTEGER" if found[f"i{i}"] == filled else "FLOAT" if found[f"r{i}"] == filled else "TEXT"
        out.append({"index": i, "name": c, "type": kind, "non_empty": filled, "empty": found["rows"] - filled, "rows": found["rows"]})
    return out
