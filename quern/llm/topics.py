"""Queries p9 over documents: their subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.subjects import Model, document_subjects, leaf_words
from quern.sources.tables import table


def _subjects(spark: SparkSession, folder: str) -> tuple[DataFrame, Model, DataFrame]:
    return document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_examples"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder)[0].select("doc_id", "subject")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject and their share of all documents; "none" for those without one."""
    found = _subjects(spark, folder)[0].select("doc_id", "subject")
    documents = table(spark, folder, "documents").select("doc_id")
    marked = documents.join(found, "doc_id", "left").select("doc_id", F.coalesce("subject", F.lit("none")).alias("subject"))
    counted = marked.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counted.withColumn("share", F.col("documents") / documents.agg(F.count(F.lit(1))).scalar())


def p9_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """The leaves of the clustering with their first discriminative terms and the part of each subject."""
    _, model, read = _subjects(spark, folder)
    rows = []
    for leaf, (terms, mixture) in enumerate(zip(leaf_words(read, model), model.mixtures, strict=True)):
        for subject, part in zip(model.lexicon.subjects, mixture, strict=True):
            if terms:
                rows.append((leaf, subject, round(float(part), 4), ", ".join(terms)))
    return spark.createDataFrame(rows, "leaf int, subject string, part double, terms string")


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_leaves": p9_leaves}
ORACLES: dict[str, str] = {}
