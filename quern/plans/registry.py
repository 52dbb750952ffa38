"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import decision, features, paths, streams, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (decision, paths, features, streams, upkeep):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
