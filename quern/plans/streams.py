"""Streaming queries over events, and the link-table operations of the second workload."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.operators import access, changes, statistics
from quern.session import shared_dir
from quern.streaming import events as live


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return live.read_stream(spark, folder, "events")


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return live.run_to_end(live.windowed_counts(_stream(spark, folder), "ts", ["event_type"], "1 hour"), "complete")


def stream_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that are over an hour after the last event seen; later ones stay open."""
    return live.run_to_end(live.windowed_counts(_stream(spark, folder), "ts", ["event_type"], "1 day", delay="1 hour"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return live.run_to_end(live.windowed_counts(_stream(spark, folder), "ts", [], "6 hours", "2 hours"), "complete")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return live.run_to_end(live.sessions(_stream(spark, folder), "ts", "user_id", "30 minutes"), "complete")


def batch_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return live.sessions(Catalog(spark, folder).read("events"), "ts", "user_id", "30 minutes")


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    stream = _stream(spark, folder).select("event_id", "ts", "user_id")
    return live.run_to_end(live.without_repeats(stream, ["event_id"], "ts", "10 minutes"))


def _in_files(spark: SparkSession, folder: str, files: int = 5) -> DataFrame:
    """The events as a stream of files in order of time, one a batch, so that state and watermark pass from batch to batch."""
    root = f"{shared_dir(spark)}/quern-events-{uuid.uuid4().hex}"
    events = Catalog(spark, folder).read("events")
    seconds = F.col("ts").cast("timestamp").cast("double")
    cuts = events.select(F.percentile_approx(seconds, [i / files for i in range(1, files)])).first()[0] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = events if low is None else events.where(seconds >= low)
        (part if high is None else part.where(seconds < high)).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root)


def stream_files_windows(spark: SparkSession, folder: str) -> DataFrame:
    return live.run_to_end(live.windowed_counts(_in_files(spark, folder), "ts", ["event_type"], "1 day", delay="1 hour"))


def stream_files_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = live.run_to_end(live.running_totals(_in_files(spark, folder), "user_id", "value"), "update")
    return found.groupBy("key").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")).select(F.col("key").alias("user_id"), "n", "total")


def stream_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = live.run_to_end(live.running_totals(_stream(spark, folder), "user_id", "value"), "update")
    return found.groupBy("key").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")).select(F.col("key").alias("user_id"), "n", "total")


LINK = ["event_id", "user_id", "ts", "event_type"]


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return Catalog(spark, folder).read("events").select(*LINK)


def link_add(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder)
    new = links.where("user_id = 7").withColumn("event_id", F.col("event_id") + 100_000_000)
    return changes.insert_unique(links, new.unionByName(links.where("user_id = 9")), ["event_id"], ["ts"], ignore=True)


QUERIES = {
    "stream_tumbling": stream_tumbling, "stream_watermark": stream_watermark, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions,
    "batch_sessions": batch_sessions, "stream_dedupe": stream_dedupe, "stream_running_totals": stream_running_totals,
    "stream_files_windows": stream_files_windows, "stream_files_totals": stream_files_totals,
    "link_get": lambda s, f: access.lookup(_links(s, f), ["event_id"], [1234]),
    "link_multiget": lambda s, f: access.lookup_many(_links(s, f), ["event_id"], _links(s, f).where("user_id = 3").select("event_id")),
    "link_list_newest": lambda s, f: access.last(access.lookup(_links(s, f), ["user_id"], [7]), ["ts", "event_id"], 20),
    "link_list_between": lambda s, f: access.range_scan(_links(s, f).withColumn("day", F.col("ts").cast("date")), ["user_id", "day"], [7, "2024-01-05"], [7, "2024-01-15"]).drop("day"),
    "link_count": lambda s, f: statistics.records_in_range(_links(s, f), ["user_id"], [7], [7]),
    "link_add": link_add,
    "link_update": lambda s, f: changes.update_where(_links(s, f), F.col("user_id") == 7, {"event_type": F.lit("hidden")}),
    "link_delete": lambda s, f: changes.delete_where(_links(s, f), (F.col("user_id") == 7) & (F.col("event_type") == "click")),
}

_K = ", ".join(LINK)
_TOTAL = "count(*)::BIGINT AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total"
_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
ORACLES = {
    "stream_tumbling": f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, {_TOTAL} FROM events GROUP BY ALL",
    "stream_watermark": f"""SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, {_TOTAL} FROM events GROUP BY ALL)
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_sliding": f"""WITH e AS (SELECT *, unnest([0, 2, 4]) AS back FROM events)
SELECT time_bucket(INTERVAL 2 HOUR, ts) - back * INTERVAL 1 HOUR AS window_start, time_bucket(INTERVAL 2 HOUR, ts) - back * INTERVAL 1 HOUR + INTERVAL 6 HOUR AS window_end, {_TOTAL} FROM e GROUP BY ALL""",
    "stream_sessions": _SESSIONS,
    "batch_sessions": _SESSIONS,
    "stream_dedupe": "SELECT event_id, ts, user_id FROM events",
    "stream_running_totals": "SELECT user_id, count(*)::BIGINT AS n, sum(round(value * 10000)::BIGINT)::DOUBLE / 10000 AS total FROM events GROUP BY ALL",
    "link_get": f"SELECT {_K} FROM events WHERE event_id = 1234",
    "link_multiget": f"SELECT {_K} FROM events WHERE user_id = 3",
    "link_list_newest": f"SELECT {_K} FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "link_list_between": f"SELECT {_K} FROM events WHERE user_id = 7 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'",
    "link_count": "SELECT count(*)::BIGINT AS records FROM events WHERE user_id = 7",
    "link_add": f"SELECT {_K} FROM events UNION ALL SELECT event_id + 100000000, user_id, ts, event_type FROM events WHERE user_id = 7",
    "link_update": "SELECT event_id, user_id, ts, CASE WHEN user_id = 7 THEN 'hidden' ELSE event_type END AS event_type FROM events",
    "link_delete": f"SELECT {_K} FROM events WHERE NOT (user_id = 7 AND event_type = 'click')",
}
ORACLES |= {"stream_files_windows": ORACLES["stream_watermark"], "stream_files_totals": ORACLES["stream_running_totals"]}
