"""Tables stored as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T


_SCHEMAS: dict[tuple[str, int, int], T.StructType] = {}


def schema_of(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a single file, kept as long as the file is the same; Spark runs a job to find one.
    None for a folder, whose files can change unseen."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    if not status.isFile():
        return None
    key = path, status.getLen(), status.getModificationTime()
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return _SCHEMAS[key]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``; filters and column lists reach its scan through Catalyst."""
    path = f"{folder}/{name}.parquet"
    schema = schema_of(spark, path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Make tables visible to SQL."""
    for name in names:
        read(spark, folder, name).createOrReplaceTempView(name)
