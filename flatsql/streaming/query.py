"""Queries over growing folders: the same plans, built on a streaming DataFrame.

Filters, projections, functions and LIMIT run in append mode. DISTINCT keeps what it has seen in the state
store. GROUP BY and aggregates run in complete mode, ORDER BY only above it in complete mode, and joins with a
table that does not grow; what Structured Streaming cannot run, it rejects when the query starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flatsql.api import Engine
from flatsql.plans.ast import Query
from flatsql.plans.parser import parse
from flatsql.plans.planner import is_grouped
from flatsql.sources.csv import delimiter


def csv_stream(spark: SparkSession, folder: str, columns: list[str], sep: str = ",", files_per_trigger: int | None = None, multiline: bool = True) -> DataFrame:
    """CSV files as they arrive in a folder, as text columns; missing values are empty.

    multiline False splits large files and takes it that quoted fields hold no line breaks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(header=True, sep=delimiter(sep), quote='"', escape='"', mode="PERMISSIVE", multiLine=multiline)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder).fillna("")


def stream_sql(engine: Engine, sql: str, source: DataFrame) -> DataFrame:
    """The query as a streaming DataFrame; '-' in FROM is the stream."""
    engine.resolver.stdin = lambda: source
    return engine.sql(sql)


def output_mode(query: Query) -> str:
    return "complete" if is_grouped(query) or (query.order_by and not query.distinct) else "append"


def start(engine: Engine, sql: str, source: DataFrame, name: str, checkpoint: str | None = None, available_now: bool = True, path: str | None = None) -> StreamingQuery:
    """Starts the query into the folder of Parquet files at path, or without one into a table in memory called name.

    A result that grows is added to the folder; aggregates, which change, are written anew with every batch.
    """
    mode = output_mode(parse(sql))
    writer = stream_sql(engine, sql, source).writeStream.outputMode(mode).queryName(name)
    if path is None:
        writer = writer.format("memory")
    elif mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


