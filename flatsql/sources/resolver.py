"""What FROM names: a registered table, a view, a file or a table of the base folder."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flatsql.errors import QueryError
from flatsql.sources.csv import read_csv
from flatsql.sources.parquet import read_parquet

_TEXTS = (".csv", ".tsv", ".txt", ".csv.gz", ".tsv.gz", ".csv.bz2")


class Resolver:
    def __init__(self, spark: SparkSession, base: str | None = None, sep: str = ",", multiline: bool | None = None, stdin: Callable[[], DataFrame] | None = None):
        self.spark, self.base, self.sep, self.multiline, self.stdin = spark, base, sep, multiline, stdin
        self.tables: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in ("-", "stdin"):
            if self.stdin is None:
                raise QueryError("there is no standard input here")
            return self.stdin()
        lower = name.lower()
        if lower.endswith(".parquet"):
            return read_parquet(self.spark, name)
        if lower.endswith(_TEXTS) or (os.path.isfile(name) and not self.base):
            return read_csv(self.spark, name, "\t" if ".tsv" in lower and self.sep == "," else self.sep, self.multiline)
        if self.base and re.fullmatch(r"\w+", name):
            return read_parquet(self.spark, f"{self.base}/{name}.parquet")
        if re.fullmatch(r"\w+(\.\w+)*", name) and self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        if "*" in name or "/" in name or os.path.exists(name):
            return read_csv(self.spark, name, self.sep, self.multiline)
        raise QueryError(f"no such table or file: {name}")
