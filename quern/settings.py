"""The declared settings of the engine and what answers to them here.

A setting without a counterpart is accepted and does nothing: Spark manages memory, pages and journals itself.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Setting -> the configuration it stands for, if any. The names are the declared interface.
COUNTERPARTS: dict[str, str | None] = {
    "max_mem_use": "spark.executor.memory",
    "current_mem_use": None,
    "journal_size": None,
    "journal_lower_max": None,
    "journal_upper_max": None,
    "efficient_text": "spark.sql.parquet.compression.codec",
    "column_cache_factor": "spark.memory.storageFraction",
    "reduce_tree_use_on_unlock": None,
    "reduce_index_tree_use_on_unlock": None,
    "reduce_storage_use_on_unlock": None,
    "cleanup_time": None,
    "use_primitive_indexes": None,
    "block_read_ahead": "spark.quern.readAhead",
    "contact_points": "spark.master",
    "red_address": "spark.driver.host",
    "resolve_values_from_index": None,
    "use_internal_pool": None,
    "reset_statistics": "spark.quern.resetStatistics",
}
#: Values of switches that stand for a configuration with values of its own.
VALUES = {"efficient_text": {"true": "zstd", "false": "snappy"}}


def current(spark: SparkSession) -> dict[str, str | None]:
    """Each setting with the value its counterpart has."""
    return {name: spark.conf.get(key, None) if key else None for name, key in COUNTERPARTS.items()}


def apply(spark: SparkSession, name: str, value: str | int | bool) -> bool:
    """Set a setting for this session; whether it has an effect from now on.

    An unknown name is an error. Settings without a counterpart, and those that only a new application
    can take up, are accepted without effect.
    """
    if name not in COUNTERPARTS:
        raise KeyError(f"no setting {name}")
    key, text = COUNTERPARTS[name], str(value).lower() if isinstance(value, bool) else str(value)
    if key is None or (not key.startswith("spark.quern.") and not spark.conf.isModifiable(key)):
        return False
    spark.conf.set(key, VALUES.get(name, {}).get(text, text))
    return True


def is_on(spark: SparkSession, name: str) -> bool:
    key = COUNTERPARTS[name]
    return str(spark.conf.get(key, "0") if key else "0").lower() not in ("0", "false", "")
