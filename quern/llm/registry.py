"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import orders, texts, together, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (orders, texts, together, topics):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
