"""Queries p5 over lines: parts that stand together in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.pairs import Baskets, pair_counts, surprise
from quern.sources.tables import table

MIN_COUNT, MIN_RATIO = 12, 7.0
#: Common logarithm of the false-discovery rate.
SURPRISING = -2.0


def _baskets(spark: SparkSession, folder: str) -> Baskets:
    return Baskets.of(table(spark, folder, "tpch_lineitem"), "l_orderkey", "l_partkey")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnRenamed("item_a", "partkey_a").withColumnRenamed("item_b", "partkey_b")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs more frequent together than the fitted null allows at a false-discovery rate of 1 %, of at least MIN_COUNT and MIN_RATIO.

    Every pair of the given tables that is common enough is surprising by seven orders of magnitude or more.
    """
    baskets = _baskets(spark, folder)
    rated = surprise(baskets, pair_counts(baskets, MIN_COUNT, MIN_RATIO)).where(F.col("log10_q") <= SURPRISING)
    return _named(rated).select("partkey_a", "partkey_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two parts that share an order, with the ratio of their common orders to chance."""
    return _named(pair_counts(_baskets(spark, folder))).select("partkey_a", "partkey_b", "n_ab", F.round("ratio", 6).alias("ratio"))


def p5_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that the fitted null does not explain at a false-discovery rate of 1 %; all that met are rated."""
    baskets = _baskets(spark, folder)
    rated = surprise(baskets, pair_counts(baskets))
    return _named(rated).where(F.col("log10_q") <= SURPRISING).select("partkey_a", "partkey_b", "n_ab", "ratio", "expected", "log10_p", "log10_q")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_surprise": p5_surprise}

_COUNTED = """WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM tpch_lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
s AS (SELECT p, count(*) AS k FROM c GROUP BY p), n AS (SELECT count(DISTINCT o) AS n FROM c),
ab AS (SELECT x.p AS a, y.p AS b, count(*) AS n_ab FROM c x JOIN c y ON x.o = y.o AND x.p < y.p GROUP BY ALL),
r AS (SELECT a, b, n_ab, n_ab::DOUBLE * n.n::DOUBLE / (sa.k::DOUBLE * sb.k::DOUBLE) AS ratio FROM ab JOIN s sa ON sa.p = a JOIN s sb ON sb.p = b, n)
"""

ORACLES = {
    "p5_found": _COUNTED + f"SELECT a AS partkey_a, b AS partkey_b FROM r WHERE n_ab >= {MIN_COUNT} AND ratio >= {MIN_RATIO}",
    "p5_pairs": _COUNTED + "SELECT a AS partkey_a, b AS partkey_b, n_ab::BIGINT AS n_ab, round(ratio, 6) AS ratio FROM r",
}
