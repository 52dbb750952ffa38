"""Items that appear together: exact pair counts against a fitted null.

Counting. Baskets of distinct items are cut into chunks, and pairs are formed inside a chunk and between
two chunks of a basket, so no task holds a whole large basket. With a least count m, the m - 1 largest
baskets are not expanded at all: a pair that is common enough must also stand in another basket, and what
the large ones add to it is found by comparing lists of them. Items that cannot reach the least count or
the least ratio are left out before any pair is formed; both bounds are exact.

Null. In the bipartite configuration model item a is in basket o with probability x_a y_o / (1 + x_a y_o),
independently, x and y fitted so that every item's frequency and every basket's size are met on average.
Equal frequencies have equal x and equal sizes equal y, so the fit runs over the histograms. The number of
baskets with both items is then Poisson-binomial; its upper tail is the pair's p value, and the
Benjamini-Hochberg step over all pairs of items turns p into q, the false-discovery rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import HOT_PARTS, join_counted
from quern.session import materialize

#: Items of a basket expanded in one go.
CHUNK = 256
#: Baskets below this many items are always expanded.
LARGE_BASKET = 4096
#: Frequencies and sizes up to this have a class of their own, larger ones share one with their like within GROWTH.
EXACT_CLASSES, GROWTH = 512, 1.01
#: p values are rounded up to this many steps a decade before ranking.
STEPS = 100
#: Decades told apart; below 10 ** -DECADES all p are equal.
DECADES = 300


def degree_class(n: Column) -> Column:
    """Class of a frequency or size; its members differ by one part in a hundred at most."""
    far = F.lit(EXACT_CLASSES) + F.floor(F.log(n / F.lit(float(EXACT_CLASSES))) / F.lit(math.log(GROWTH)))
    return F.when(n <= EXACT_CLASSES, n).otherwise(far + 1).cast("int")


@dataclass
class Null:
    """Fitted classes: item classes with x, basket classes with y and their numbers."""

    item_x: dict[int, float]
    basket_y: np.ndarray
    basket_n: np.ndarray


def fit_null(items: list[tuple[int, float, int]], baskets: list[tuple[int, float, int]], rounds: int = 500, close: float = 1e-8) -> Null:
    """Fixed-point fit from (class, mean degree, number) of items and of baskets."""
    if not items or not baskets:
        return Null({}, np.zeros(0), np.zeros(0))
    k, m = np.array([d for _, d, _ in items]), np.array([float(n) for _, _, n in items])
    d, n = np.array([d for _, d, _ in baskets]), np.array([float(c) for _, _, c in baskets])
    scale = math.sqrt(float((k * m).sum()))
    x, y = k / scale, d / scale
    full_items, full_baskets = k >= n.sum(), d >= m.sum()  # in every basket, or with every item
    for _ in range(rounds):
        old = x
        x = np.where(full_items, 1e12, k / ((n * y) / (1 + np.outer(x, y))).sum(axis=1))
        y = np.where(full_baskets, 1e12, d / ((m[:, None] * x[:, None]) / (1 + np.outer(x, y))).sum(axis=0))
        if np.max(np.abs(x - old) / x) < close:
            break
    return Null({c: float(v) for (c, _, _), v in zip(items, x, strict=True)}, y, n)


def upper_tail(null: Null, class_a: np.ndarray, class_b: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected number and log10 P(N >= count) of the Poisson-binomial count of common baskets.

    The tail is the saddlepoint approximation for lattice variables, exact in both limits (one basket
    class, rare events) to a few per cent; counts at or below the mean give p = 1 at most.
    """
    xa = np.array([null.item_x.get(int(c), 0.0) for c in class_a])[:, None]
    xb = np.array([null.item_x.get(int(c), 0.0) for c in class_b])[:, None]
    y, n = null.basket_y[None, :], null.basket_n[None, :]
    q = np.clip(xa * y / (1 + xa * y) * (xb * y / (1 + xb * y)), 0.0, 1 - 1e-12)
    mean = (n * q).sum(axis=1)
    c = count.astype(float)
    most = n.sum()
    at = np.minimum(c - 0.5, most - 0.5)  # continuity: P(N >= c) = P(N > c - 1/2)
    t = np.log(np.maximum(at, 0.25) / np.maximum(mean, 1e-300))
    for _ in range(60):  # K'(t) = at, by Newton's method held inside its bracket
        z = q * np.exp(np.minimum(t, 690.0))[:, None]
        p = z / (1 - q + z)
        slope, curve = (n * p).sum(axis=1), (n * p * (1 - p)).sum(axis=1)
        step = np.clip((at - slope) / np.maximum(curve, 1e-300), -2.0, 2.0)
        t = t + step
        if np.max(np.abs(step), initial=0.0) < 1e-10:
            break
    z = q * np.exp(np.minimum(t, 690.0))[:, None]
    p = z / (1 - q + z)
    curve = np.maximum((n * p * (1 - p)).sum(axis=1), 1e-300)
    cumulant = (n * np.log1p(z - q)).sum(axis=1)
    gap = np.maximum(t * at - cumulant, 0.0)
    w = np.sign(t) * np.sqrt(2 * gap)
    u = 2 * np.sinh(np.clip(t / 2, -300, 300)) * np.sqrt(curve)
    with np.errstate(all="ignore"):
        body = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.minimum(w, 35.0)])
        density = np.exp(-np.minimum(w, 35.0) ** 2 / 2) / math.sqrt(2 * math.pi)
        direct = body + density * (1 / u - 1 / w)
        log_p = np.log10(np.clip(direct, 1e-300, 1.0))
        # far out: log of phi(w) * (1/u + 1/w^3), the tail of the normal with its first correction
        far = (-(w**2) / 2 - 0.5 * math.log(2 * math.pi)) / math.log(10) + np.log10(np.maximum(1 / u - 1 / np.maximum(w, 1.0) ** 3, 1e-12 / np.maximum(u, 1e-300)))
        log_p = np.where(w > 12, far, log_p)
        log_p = np.where(t <= 1e-4, np.log10(np.clip(np.where(np.abs(t) < 1e-4, 0.5, direct), 1e-300, 1.0)), log_p)
    log_p = np.where(c <= 0, 0.0, log_p)
    log_p = np.where(c > most, -np.inf, log_p)
    return mean, np.minimum(log_p, 0.0)


def _histogram(sizes: DataFrame, size: str) -> list[tuple[int, float, int]]:
    rows = sizes.groupBy(degree_class(F.col(size)).alias("c")).agg(F.avg(size).alias("d"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r.c, float(r.d), int(r.n)) for r in rows)  # as many as there are classes: some thousands at most


@dataclass
class Baskets:
    """Distinct (basket, item), and the size of each basket and frequency of each item; tables in the shared folder."""

    cells: DataFrame
    items: DataFrame
    sizes: DataFrame
    n_cells: int
    n_baskets: int

    @staticmethod
    def of(df: DataFrame, basket: str, item: str) -> Baskets:
        """Rows with a null basket or item are left out, repeated rows count once."""
        good = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
        cells = materialize(good.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct(), "cells")
        sizes = materialize(cells.groupBy("basket").agg(F.count(F.lit(1)).alias("size")), "sizes")
        items = materialize(cells.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "items")
        return Baskets(cells, items, sizes, cells.count(), sizes.count())


def pair_counts(baskets: Baskets, min_count: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, ratio), item_a < item_b: n_ab baskets hold both, ratio times as many
    as chance would give, n_ab * n / (n_a * n_b). Pairs below min_count or min_ratio are left out."""
    n = baskets.n_baskets
    cells, items = baskets.cells, baskets.items
    # n_ab <= min(n_a, n_b), so ratio <= n / max(n_a, n_b); and an item of a pair has n_item >= min_count.
    items = items.where(F.col("n_item") >= min_count)
    if min_ratio > 0:
        items = items.where(F.col("n_item") * F.lit(float(min_ratio)) <= n)
    used = join_counted(cells, items, ["item"], "n_item", baskets.n_cells, ["basket"]).drop("__salt")

    large: list = []
    if min_count > 1:
        large = [r.basket for r in baskets.sizes.where(F.col("size") > LARGE_BASKET).orderBy(F.desc("size"), "basket").limit(min_count - 1).collect()]
    spread = used.where(~F.col("basket").isin(large)) if large else used

    cut = _with_chunks(spread, baskets)
    member = F.struct("item", "n_item")
    # Read three times below: the pairs inside a list, and both sides of those across two.
    lists = materialize(cut.groupBy("basket", "__salt", "chunk", "chunks").agg(F.array_sort(F.collect_list(member)).alias("members")).drop("__salt"), "lists")
    inside = lists.where(F.size("members") > 1).select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size("members") - 1),
                    lambda i: F.transform(F.slice("members", i + 1, F.size("members")), lambda m: F.struct(F.element_at("members", i).alias("a"), m.alias("b"))),
                )
            )
        ).alias("p")
    )
    many = lists.where("chunks > 1")
    # Two chunks meet under a key of their own, so the work of one large basket is spread.
    first = many.where(F.col("chunk") < F.col("chunks") - 1).select("basket", F.col("chunk").alias("ca"), F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("cb"), "members")
    second = many.where(F.col("chunk") > 0).select("basket", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("ca"), F.col("chunk").alias("cb"), F.col("members").alias("members_b"))
    across = (
        first.join(second, ["basket", "ca", "cb"])
        .select(F.explode("members").alias("x"), "members_b")
        .select("x", F.explode("members_b").alias("y"))
        .select(F.when(F.col("x.item") < F.col("y.item"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b"))).alias("p"))
    )
    found = (
        inside.unionByName(across)
        .select(F.col("p.a.item").alias("item_a"), F.col("p.b.item").alias("item_b"), F.col("p.a.n_item").alias("n_a"), F.col("p.b.n_item").alias("n_b"))
        .groupBy("item_a", "item_b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("n_ab"))
    )
    if large:
        held = used.where(F.col("basket").isin(large)).groupBy("item").agg(F.collect_list("basket").alias("in_large"))
        a, b = held.select(F.col("item").alias("item_a"), F.col("in_large").alias("la")), held.select(F.col("item").alias("item_b"), F.col("in_large").alias("lb"))
        more = F.coalesce(F.size(F.array_intersect("la", "lb")), F.lit(0))
        found = found.join(a, "item_a", "left").join(b, "item_b", "left").withColumn("n_ab", F.col("n_ab") + F.when(F.col("la").isNotNull() & F.col("lb").isNotNull(), more).otherwise(F.lit(0))).drop("la", "lb")
    ratio = F.col("n_ab").cast("double") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    kept = found.where(F.col("n_ab") >= min_count).withColumn("ratio", ratio)
    return kept.where(F.col("ratio") >= min_ratio) if min_ratio > 0 else kept


def _with_chunks(cells: DataFrame, baskets: Baskets) -> DataFrame:
    """chunk and chunks of each cell: a basket of s items has ceil(s / CHUNK) chunks, by hash of the item.

    Baskets with one part in HOT_PARTS of all cells or more, fewer than HOT_PARTS, are told by a broadcast and
    shuffled by chunk; the others by basket, which they fill a small part of.
    """
    wanted = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    many = baskets.sizes.where(F.col("size") > CHUNK)
    is_hot = F.col("size") * F.lit(HOT_PARTS) >= F.lit(baskets.n_cells)
    chunk = lambda k: F.pmod(F.xxhash64("item"), F.col(k)).cast("int")
    marked = cells.join(F.broadcast(many.where(is_hot).select("basket", wanted.alias("__hot"))), "basket", "left")
    salted = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), chunk("__hot")).otherwise(F.lit(0)))
    others = many.where(~is_hot).select("basket", F.lit(0).alias("__salt"), wanted.alias("__k"))
    joined = salted.join(others, ["basket", "__salt"], "left").withColumn("chunks", F.coalesce("__hot", "__k", F.lit(1)))
    return joined.withColumn("chunk", chunk("chunks")).drop("__hot", "__k")


def surprise(baskets: Baskets, pairs: DataFrame) -> DataFrame:
    """pairs with expected, log10_p and log10_q under the fitted null.

    q counts every pair of items of the table as tested, those that never met included. Ranks count the
    pairs given, so `pairs` should hold all that met: q is too large, never too small, for what is left of
    a selection - as long as what was left out is not more surprising.

    The tail depends on the two classes and the count alone; it is found once for each such kind of pair.
    """
    items = _histogram(baskets.items, "n_item")
    null = fit_null(items, _histogram(baskets.sizes, "size"))
    n_items = sum(n for _, _, n in items)
    tests = math.log10(max(1.0, n_items * (n_items - 1) / 2))
    kind = ["__ca", "__cb", "n_ab"]
    a, b = degree_class(F.col("n_a")), degree_class(F.col("n_b"))
    classed = materialize(pairs, "pairs").withColumn("__ca", F.least(a, b)).withColumn("__cb", F.greatest(a, b))
    kinds = classed.groupBy(*kind).agg(F.count(F.lit(1)).alias("__k"))
    schema = kinds.withColumn("expected", F.lit(0.0)).withColumn("log10_p", F.lit(0.0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, log_p = np.zeros(len(pdf)), np.zeros(len(pdf))
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                mean[at : at + 2000], log_p[at : at + 2000] = upper_tail(null, part["__ca"].to_numpy(), part["__cb"].to_numpy(), part["n_ab"].to_numpy())
            yield pdf.assign(expected=mean, log10_p=log_p)

    tailed = kinds.mapInPandas(run, schema)
    # Benjamini-Hochberg over p rounded up: ranks come from counts per step, of which there are STEPS * DECADES at most.
    step = F.greatest(F.floor(F.col("log10_p") * -STEPS), F.lit(0)).cast("int")
    stepped = materialize(tailed.withColumn("__step", F.least(step, F.lit(STEPS * DECADES))), "kinds")
    ladder = stepped.groupBy("__step").agg(F.sum("__k").alias("k"))
    rank = F.sum("k").over(Window.orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, 0))
    raw = ladder.select("__step", (F.lit(tests) - F.col("__step") / STEPS - F.log10(rank.cast("double"))).alias("raw"))
    least = F.min("raw").over(Window.orderBy(F.asc("__step")).rowsBetween(Window.unboundedPreceding, 0))
    # A step is one of STEPS * DECADES, a hot kind of pair is one of few: both are bounded whatever the pairs.
    rated = stepped.join(F.broadcast(raw.select("__step", F.least(least, F.lit(0.0)).alias("log10_q"))), "__step").drop("__step")
    total = int(stepped.agg(F.coalesce(F.sum("__k"), F.lit(0))).first()[0])
    found = join_counted(classed, rated, kind, "__k", total, ["item_a", "item_b"])
    return found.select(*pairs.columns, "expected", "log10_p", "log10_q")
