"""Parquet tables. The schema of a table that is one file is read once as long as the file stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SCHEMAS: dict[tuple, T.StructType] = {}
REMEMBERED = 256


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table at path. Its schema takes a job to read; that of a single file is remembered by path, time of change and size.

    A folder's own time and size say nothing of changes further down, so the schemas of folders are read each time.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if "*" in path or not files.exists(target):
        return spark.read.parquet(path)
    status = files.getFileStatus(target)
    if not status.isFile():
        return spark.read.parquet(path)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        if len(_SCHEMAS) >= REMEMBERED:
            _SCHEMAS.clear()
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
