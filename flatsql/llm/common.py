"""What the operators share: scratch tables that cut lineage, column expressions, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take lower(), which agrees there and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one under the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


#: Record batches that go to Python while a scratch table is written: so many rows and bytes at most.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written for one job in the shared folder.

    A written table cuts lineage and outlives executors. What the job returns reads its tables lazily,
    so they stay until drop(), drop_scratch() or the end of the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.dir = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(self._at_exit)
        _MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """df, written as Parquet and read back; shuffle files that nothing refers to are let go."""
        with settings(self.spark, ARROW):
            df.write.option("compression", "zstd").parquet(self.path(name), partitionBy=list(partition_by) or None)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """Shuffle files are deleted when the driver collects garbage, which may be long after their last use."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, name: str) -> None:
        self._delete(self.path(name))

    def drop(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.dir)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            self.drop()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_MADE: list[Scratch] = []


def drop_scratch() -> None:
    """Removes the tables of all jobs so far, for long sessions: results that were not written can then not be read any more."""
    while _MADE:
        _MADE.pop().drop()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, of which a worker makes Python objects one at a time."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Plain tuples of the named columns."""
    for batch in slices(batches):
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 1, limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose sizes sum to about limit."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
