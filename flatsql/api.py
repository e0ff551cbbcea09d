"""The engine as a library."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from flatsql.plans.ast import Query
from flatsql.plans.parser import parse
from flatsql.plans.planner import plan
from flatsql.plans.simple import parse_simple
from flatsql.sinks.text import text_of
from flatsql.sources.csv import profile
from flatsql.sources.resolver import Resolver

if TYPE_CHECKING:
    import pandas as pd


def session() -> SparkSession:
    """The active session, or a local one. Dates are read and shown in UTC."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.appName("flatsql").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return spark


class Engine:
    """Runs queries. base: a folder of Parquet tables that bare names in FROM mean."""

    def __init__(self, spark: SparkSession | None = None, base: str | None = None, sep: str = ",", multiline: bool | None = None, stdin: Callable[[], DataFrame] | None = None):
        self.spark = spark or session()
        self.resolver = Resolver(self.spark, base, sep, multiline, stdin)

    def register(self, name: str, df: DataFrame) -> Engine:
        self.resolver.tables[name] = df
        return self

    def sql(self, text: str) -> DataFrame:
        return plan(parse(text), self.resolver)

    def simple(self, args: Sequence[str]) -> DataFrame:
        return plan(parse_simple(args), self.resolver)

    def run(self, query: Query) -> DataFrame:
        return plan(query, self.resolver)

    def profile(self, path: str) -> list[dict[str, object]]:
        return profile(self.resolver(path))


def query(sql: str, **options: object) -> list[dict[str, object]]:
    """The rows as dictionaries of typed values."""
    return [row.asDict() for row in Engine(**options).sql(sql).collect()]


def query_tuples(sql: str, **options: object) -> tuple[list[str], list[tuple]]:
    """The column names, and the rows as tuples of typed values."""
    df = Engine(**options).sql(sql)
    return df.columns, [tuple(row) for row in df.collect()]


def query_csv(sql: str, **options: object) -> str:
    return text_of(Engine(**options).sql(sql), "csv")


def query_df(sql: str, **options: object) -> pd.DataFrame:
    return Engine(**options).sql(sql).toPandas()
