"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Schemas read from footers, by session, path and time of change: finding one out costs a Spark job.
_schemas: dict[tuple[str, str, int], T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = (context.applicationId, path, changed)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)
