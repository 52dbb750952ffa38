"""A mix of sources with target shares of its size, by Poisson replication.

Every record draws how often it is taken from a Poisson distribution, by inverting it at a number made
from a hash of the record's id and a seed: the draw needs no state, is the same on every executor and
every try, and can be repeated record by record. A record's count never exceeds its source's cap; the rate
of each source is set so that, with the draws as they are, its tokens come to the target.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialize

#: Vocabulary in tiktoken's format, and the pattern that splits a text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cells of the draw's range in which tokens are summed to set the rates.
CELLS = 4096
#: The highest rate that is told from "as often as allowed".
TOP_RATE = 700.0

_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file's content; one in a process."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _encoders:
        import tiktoken

        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encoders[key]


def read_vocabulary(vocabulary: str) -> bytes:
    """The content of a vocabulary file, as the driver sees it; some megabytes whatever the data."""
    with open(vocabulary, "rb") as lines:
        return lines.read()


def count_tokens(df: DataFrame, text: str, keep: list[str], *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(keep, n_tokens): tokens of each text; 0 for a null or empty one. Special tokens are plain text here.

    The vocabulary is sent to the executors; they need no file of their own.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])
    ranks = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    held = text in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(keep.index(text) if held else len(keep))
            counts = [len(code.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return df.select(*keep, *([] if held else [F.col(text).alias("__text")])).mapInArrow(run, schema)


def clean_source(column: Column) -> Column:
    """A source's name whatever its letter case, padding or inner hyphens."""
    return F.replace(F.lower(F.trim(column)), F.lit("-"), F.lit(""))


def draw(record_id: str, seed: int) -> Column:
    """A number in [0, 1) made from the record's id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(record_id), F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(N < j) for j = 1 .. cap: a record is taken once for each of them that its draw reaches."""
    if rate >= TOP_RATE:
        return [0.0] * cap
    term, total, steps = math.exp(-rate), 0.0, []
    for j in range(1, cap + 1):
        total += term
        steps.append(min(1.0, total))
        term *= rate / j
    return steps


@dataclass(frozen=True)
class SourcePlan:
    source: str
    share: float
    cap: int
    tokens: int
    goal: float
    rate: float
    steps: tuple[float, ...]


def _taken(cells: np.ndarray, steps: list[float]) -> float:
    """Tokens taken at these steps, from the token sums of the draw's cells; inside a cell evenly."""
    above = np.r_[np.cumsum(cells[::-1])[::-1], 0.0]
    total = 0.0
    for step in steps:
        at = step * len(cells)
        k = min(int(at), len(cells) - 1)
        total += above[k + 1] + cells[k] * (1 - (at - k)) if step < 1 else 0.0
    return total


def plan_rates(cells: dict[str, np.ndarray], targets: list[tuple[str, float, int]], total: float | None = None) -> list[SourcePlan]:
    """The rate of each source. Without a total the mix is as large as its shares and caps allow.

    Sources without tokens get nothing and the others share the whole in proportion. If a total is asked
    for that a source cannot fill, that source gives all it may and its share falls short.
    """
    have = {s: float(cells[s].sum()) if s in cells else 0.0 for s, _, _ in targets}
    live = sum(share for s, share, cap in targets if have[s] > 0 and cap > 0 and share > 0)
    if live <= 0:
        return [SourcePlan(s, share, cap, int(have[s]), 0.0, 0.0, ()) for s, share, cap in targets]
    wanted = {s: share / live if have[s] > 0 and cap > 0 else 0.0 for s, share, cap in targets}
    largest = min(have[s] * cap / wanted[s] for s, _, cap in targets if wanted[s] > 0)
    size = largest if total is None else total
    plans = []
    for source, share, cap in targets:
        goal = wanted[source] * size
        if goal <= 0:
            plans.append(SourcePlan(source, share, cap, int(have[source]), 0.0, 0.0, tuple([1.0] * cap)))
            continue
        if goal >= have[source] * cap * (1 - 1e-12):
            plans.append(SourcePlan(source, share, cap, int(have[source]), have[source] * cap, math.inf, tuple([0.0] * cap)))
            continue
        low, high = 0.0, 1.0
        while high < TOP_RATE and _taken(cells[source], poisson_steps(high, cap)) < goal:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if _taken(cells[source], poisson_steps(middle, cap)) < goal else (low, middle)
        plans.append(SourcePlan(source, share, cap, int(have[source]), goal, high, tuple(poisson_steps(high, cap))))
    return plans


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, cap) of the table of targets, whose rows are one a source; names are cleaned."""
    rows = (
        targets.where(F.col("source_name").isNotNull())
        .groupBy(clean_source(F.col("source_name")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        .orderBy("source")
        .collect()
    )
    return [(r.source, float(r.share or 0.0), int(r.cap or 0)) for r in rows]


def mix_sources(
    documents: DataFrame, targets: DataFrame, record_id: str = "doc_id", text: str = "text", source: str = "source",
    *, total_tokens: int | None = None, seed: int = 20, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report): the records of the mix in a random order, and the shares it reached.

    mix has record_id, source_name, copy_no from 1, n_tokens and text. Records of sources that are no target (or
    null) and records without tokens are in no mix. report has a row per target: source_name,
    target_share, max_repeats, source_tokens, mixed_records, mixed_tokens, reached_share, most_repeats.
    An empty table gives an empty mix and a report of zeros. A repeated id is two records with one draw.

    Texts are tokenized once and kept in the shared folder with their counts, so that no record has to be
    joined to its text again; the text is read back for the records taken, once each. What reaches the driver is a table of
    CELLS sums a source. Every record decides on its own, so a source with most of the rows is spread as
    the files are, and the order is a shuffle by hash.
    """
    asked = read_targets(targets)
    named = documents.withColumn("__source", clean_source(F.col(source)))
    keep = named.where(F.col("__source").isin([s for s, _, _ in asked]))
    counted = materialize(count_tokens(keep.withColumn("__text", F.col(text)), "__text", [record_id, "__source", "__text"], vocabulary=vocabulary, pattern=pattern), "tokens")
    drawn = counted.where(F.col("n_tokens") > 0).withColumn("__u", draw(record_id, seed))

    sums = drawn.groupBy("__source", F.floor(F.col("__u") * CELLS).cast("int").alias("cell")).agg(F.sum("n_tokens").alias("n")).collect()
    cells: dict[str, np.ndarray] = {}
    for row in sums:
        cells.setdefault(row["__source"], np.zeros(CELLS))[row.cell] = row.n
    plans = plan_rates(cells, asked, total_tokens)

    steps = F.lit(None).cast("array<double>")
    for plan in plans:
        steps = F.when(F.col("__source") == plan.source, F.array(*(F.lit(x) for x in plan.steps)).cast("array<double>")).otherwise(steps)
    taken = F.size(F.filter(steps, lambda step: (step < 1.0) & (F.col("__u") >= step)))
    copies = drawn.withColumn("__k", taken).where(F.col("__k") > 0)
    mix = copies.select(record_id, F.col("__source").alias("source_name"), F.explode(F.sequence(F.lit(1), F.col("__k"))).alias("copy_no"), "n_tokens", F.col("__text").alias("text"))
    place = F.xxhash64(F.col(record_id), F.col("copy_no"), F.lit(seed + 1))
    shuffled = mix.withColumn("__place", place).repartition("__place").sortWithinPartitions("__place").drop("__place")

    reached = copies.groupBy(F.col("__source").alias("source_name")).agg(
        F.sum("__k").alias("mixed_records"), F.sum(F.col("__k") * F.col("n_tokens")).alias("mixed_tokens"), F.max("__k").alias("most_repeats")
    )
    session = documents.sparkSession
    goals = session.createDataFrame(
        [(p.source, p.share, p.cap, p.tokens) for p in plans], "source_name string, target_share double, max_repeats int, source_tokens long"
    )
    joined = goals.join(reached, "source_name", "left").na.fill(0, ["mixed_records", "mixed_tokens", "most_repeats"])
    whole = reached.agg(F.sum("mixed_tokens")).scalar()
    report = joined.select("*", F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0)).alias("reached_share"))
    return shuffled, report
