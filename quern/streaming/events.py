"""Streams of events: windows with late data, duplicates and state of one's own, run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of a folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return source.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType, *, starting: str = "earliest", per_batch: int | None = None) -> DataFrame:
    """A topic of JSON records as a stream: the schema's columns, with the record's key, partition, offset and moment.

    A record that does not fit the schema has nulls in its columns. The Kafka connector must be among the
    session's packages; without it Spark says so when the stream is made.
    """
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if per_batch:
        source = source.option("maxOffsetsPerTrigger", per_batch)
    return parse_records(source.load(), schema)


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of JSON values (value, binary), beside where each record came from."""
    read = records.withColumn("__r", F.from_json(F.col("value").cast("string"), schema))
    return read.select("__r.*", F.col("key").cast("string").alias("record_key"), F.col("partition").alias("record_partition"), F.col("offset").alias("record_offset"), F.col("timestamp").alias("record_at"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything there is and return what came out.

    Appended rows go to a file sink; complete and updated results are written by batch, the last complete
    one or, for updates, all of them with their batch. Checkpoint and output lie in the shared folder.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/quern-stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = stream.schema if mode != "update" else stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(out)


def watermarked(events: DataFrame, at: str, delay: str) -> DataFrame:
    """Watermarks need a moment with zone: one without is read in the session's, which should be UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def windowed_counts(events: DataFrame, at: str, groups: list[str], width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Count and total per window and group; with a delay, windows come out once they are over."""
    late = watermarked(events, at, delay) if delay else events
    window = F.window(at, width, slide) if slide else F.window(at, width)
    found = late.groupBy(window.alias("w"), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *groups, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    late = watermarked(events, at, delay) if delay else events
    found = late.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), key, "n")


def without_repeats(events: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Each key once within the delay."""
    return watermarked(events, at, delay).dropDuplicatesWithinWatermark(key).withColumn(at, F.col(at).cast("timestamp_ntz"))


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch, from state kept per key. Totals are exact, in ten-thousandths."""

    def update(name: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, units = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            units += int((pdf["units"]).sum())
        state.update((n, units))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "total": [units / 10_000]})

    units = events.select(F.col(key).alias("key"), F.round(F.col(value) * 10_000).cast("long").alias("units"))
    return units.groupBy("key").applyInPandasWithState(update, "key long, n long, total double", "n long, units long", "update", GroupStateTimeout.NoTimeout)
