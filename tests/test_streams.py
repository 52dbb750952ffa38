"""Streams over several batches: state, late rows and repeats, against what plain Python makes of them."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.streaming import events as live

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, folder, batches):
    """One file a batch, in this order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


BATCHES = [
    [(1, at(0), 7, "a", 1.5), (2, at(20), 7, "a", 2.0)],
    [(3, at(200), 8, "a", 1.0), (1, at(0), 7, "a", 1.5)],
    [(4, at(10), 7, "a", 50.0), (5, at(150), 7, "a", 4.0), (6, at(210), 7, "b", 1.0)],  # the first is too late, the second not
]


def test_late_rows_are_left_out_and_windows_come_once(spark, tmp_path):
    # A window is over for rows of the batch after the one that closed it: hence the batch before the late one.
    batches = [*BATCHES[:2], [(7, at(205), 8, "a", 1.0)], BATCHES[2], [(8, at(300), 8, "a", 1.0)]]
    found = live.run_to_end(live.windowed_counts(stream(spark, tmp_path / "in", batches), "ts", [], "1 hour", delay="1 hour")).collect()
    assert sorted((r.window_start, r.n, r.total) for r in found) == [(at(0), 3, 5.0), (at(120), 1, 4.0), (at(180), 3, 3.0)]


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    found = live.run_to_end(live.running_totals(stream(spark, tmp_path / "in", BATCHES), "user_id", "value"), "update")
    last = {r.key: (r.n, r.total) for r in found.orderBy("batch").collect()}
    assert last == {7: (6, 60.0), 8: (1, 1.0)} and found.select("batch").distinct().count() == 3


def test_repeats_in_other_batches(spark, tmp_path):
    batches = [BATCHES[0], [(1, at(0), 7, "a", 1.5), (9, at(25), 7, "a", 1.0)], [(2, at(20), 7, "a", 2.0)]]
    found = live.run_to_end(live.without_repeats(stream(spark, tmp_path / "in", batches), ["event_id"], "ts", "1 hour"))
    assert sorted(r.event_id for r in found.collect()) == [1, 2, 9]


def test_sessions_over_batches(spark, tmp_path):
    found = live.run_to_end(live.sessions(stream(spark, tmp_path / "in", BATCHES[:2]), "ts", "user_id", "30 minutes", delay="1 hour")).collect()
    assert [(r.session_start, r.session_end, r.user_id, r.n) for r in found] == [(at(0), at(50), 7, 3)]


def test_an_empty_stream(spark, tmp_path):
    found = live.run_to_end(live.windowed_counts(stream(spark, tmp_path / "in", [[]]), "ts", ["event_type"], "1 hour"), "complete")
    assert found.isEmpty()


def test_records_are_parsed(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    rows = [(b"a", b'{"k": 1, "v": "x"}', 0, 5, T0), (None, b"not json", 1, 6, T0), (b"b", None, 1, 7, T0)]
    records = spark.createDataFrame(rows, "key binary, value binary, partition int, offset long, timestamp timestamp")
    found = [tuple(r)[:5] for r in live.parse_records(records, schema).orderBy("record_offset").collect()]
    assert found == [(1, "x", "a", 0, 5), (None, None, None, 1, 6), (None, None, "b", 1, 7)]
    with pytest.raises(AnalysisException):
        live.read_kafka(spark, "127.0.0.1:9", "t", schema)


def test_watermarks_keep_the_moment(spark):
    row = live.watermarked(spark.createDataFrame(BATCHES[0], SCHEMA), "ts", "1 hour").select(F.col("ts").cast("timestamp_ntz").alias("ts")).first()
    assert row.ts == at(0)
