"""Queries p7 and p8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.leakage import LENGTH, find_leaks
from quern.llm.mixing import clean_source, mix_sources
from quern.llm.reading import BLOCKS
from quern.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked documents counted by test item, items that leaked nowhere included."""
    items = table(spark, folder, "eval_items").select("item_id", "suite")
    counted = p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(counted, "item_id", "left").na.fill(0, ["documents"])


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[1]


#: How far a source's share may be off; the draws of few records leave some tokens to chance.
NEAR = 0.02


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself against what was asked: a row a source, its documents to draw from, whether shares, caps and texts are kept."""
    documents = table(spark, folder, "documents")
    mix, report = mix_sources(documents, table(spark, folder, "source_targets"))
    live = report.where("source_tokens > 0").agg(F.sum("target_share")).scalar()
    whole = mix.agg(F.sum("n_tokens")).scalar()
    per_record = mix.groupBy("source_name", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"), F.min("copy_no").alias("first"), F.max("copy_no").alias("last"), F.min("text").alias("a"), F.max("text").alias("b"))
    checked = per_record.join(documents.select("doc_id", F.col("text").alias("own")), "doc_id")
    same = (F.col("a") == F.col("own")) & (F.col("b") == F.col("own")) & (F.col("first") == 1) & (F.col("last") == F.col("times"))
    taken = checked.groupBy("source_name").agg(F.max("times").alias("most"), F.sum("tokens").alias("tokens"), F.min(same).alias("texts_kept"))
    has = documents.where("length(text) > 0").groupBy(clean_source(F.col("source")).alias("source_name")).agg(F.count(F.lit(1)).alias("documents"))
    joined = report.select("source_name", "target_share", "max_repeats").join(taken, "source_name", "left").join(has, "source_name", "left")
    reached = F.coalesce(F.col("tokens") / whole, F.lit(0.0))
    wanted = F.when(F.col("documents").isNull(), F.lit(0.0)).otherwise(F.col("target_share") / live)
    return joined.select(
        "source_name", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), (F.abs(reached - wanted) <= NEAR).alias("share_kept"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), F.coalesce("texts_kept", F.lit(True)).alias("texts_kept"),
    )


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept}
_BLOCK_TAGS = f"</?({BLOCKS})(\\s[^<>]*)?/?>"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": " ", "&#x27;": " ", "&apos;": " ", "&amp;": "&"}
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u00df": "ss"}


def _plain_sql(column: str) -> str:
    """Words of a text in SQL: tags, entities, link targets, unseen characters, full-width letters and ligatures taken away."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = f"regexp_replace(regexp_replace({column}, {quoted(_BLOCK_TAGS)}, ' ', 'gi'), '</?[a-zA-Z][a-zA-Z0-9]*(\\s[^<>]*)?/?>|<!--.*?-->', '', 'g')"
    for entity, letter in _ENTITIES.items():
        found = f"replace({found}, {quoted(entity)}, {quoted(letter)})"
    found = f"regexp_replace({found}, '!?\\[([^\\[\\]]*)\\]\\([^()\\s]*\\)', '\\1', 'g')"
    found = f"regexp_replace({found}, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    found = f"regexp_replace({found}, '([\\p{{L}}\\p{{N}}])(\\*{{1,3}}|~~|`)([\\p{{L}}\\p{{N}}])', '\\1\\3', 'g')"
    found = f"lower(translate({found}, {quoted(_FULL)}, {quoted(_HALF)}))"
    for letter, plain in _LIGATURES.items():
        found = f"replace({found}, '{letter}', '{plain}')"
    return f"regexp_extract_all({found}, '[\\p{{L}}\\p{{N}}]+')"


_LEAKS = f"""WITH d AS (SELECT doc_id, {_plain_sql('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_plain_sql('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {LENGTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {LENGTH - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS k FROM i)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

ORACLES: dict[str, str] = {
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM hits",
    "p7_items": _LEAKS + "SELECT item_id, suite, (SELECT count(*) FROM hits WHERE hits.item_id = e.item_id)::BIGINT AS documents FROM eval_items e",
    "p8_kept": """SELECT replace(lower(trim(source_name)), '-', '') AS source_name, target_share, max_repeats,
  (SELECT count(*) FROM documents WHERE length(text) > 0 AND replace(lower(trim(source)), '-', '') = replace(lower(trim(source_name)), '-', ''))::BIGINT AS documents,
  true AS share_kept, true AS cap_kept, true AS texts_kept FROM source_targets""",
}
