"""Other file formats, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Options with which a format keeps nulls, empty strings and moments as they are.
OPTIONS: dict[str, dict[str, str]] = {
    "csv": {"header": "true", "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "escape": '"', "multiLine": "false"},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"},
    "orc": {},
    "parquet": {},
}


def write_files(df: DataFrame, path: str, kind: str, *, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in OPTIONS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.format(kind).options(**OPTIONS[kind]).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Files of a format; a record that does not fit the schema is an error."""
    if kind not in OPTIONS:
        raise ValueError(f"unknown format {kind}")
    options = dict(OPTIONS[kind])
    if kind in ("csv", "json"):
        options["mode"] = "FAILFAST"
    return spark.read.format(kind).options(**options).schema(schema).load(path)
