import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import pairs, together

SCHEMA = "o long, p long, basket string, n_item long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def brute(rows):
    baskets = {}
    for o, p in rows:
        if o is not None and p is not None:
            baskets.setdefault(o, set()).add(p)
    n = Counter(p for b in baskets.values() for p in b)
    together = Counter(c for b in baskets.values() for c in itertools.combinations(sorted(b), 2))
    return {(a, b): (k, k * len(baskets) / (n[a] * n[b])) for (a, b), k in together.items()}


@pytest.mark.parametrize("chunk,large", [(256, 4096), (4, 4096), (4, 30)])
@pytest.mark.parametrize("least,ratio", [(1, 0.0), (3, 1.2)])
def test_against_brute_force(spark, monkeypatch, chunk, large, least, ratio):
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    monkeypatch.setattr(pairs, "LARGE_BASKET", large)
    rng = random.Random(4)
    rows = [(o, rng.choice([7, rng.randint(0, 40)])) for o in range(60) for _ in range(rng.randint(1, 5))]
    rows += [(o, p) for o in (1000, 1001) for p in range(38)] + [(None, 3), (3, None), (5, 5), (5, 5)]
    got = pairs.pair_counts(pairs.Baskets.of(frame(spark, rows), "o", "p"), least, ratio).collect()
    want = {k: v for k, v in brute(rows).items() if v[0] >= least and v[1] >= ratio}
    assert {(r.item_a, r.item_b): r.n_ab for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        assert r.ratio == pytest.approx(want[r.item_a, r.item_b][1])


def test_empty(spark):
    baskets = pairs.Baskets.of(frame(spark, []), "o", "p")
    assert pairs.surprise(baskets, pairs.pair_counts(baskets)).isEmpty()


def test_fit_meets_degrees():
    items, baskets = [(1, 1.0, 50), (2, 5.0, 30), (3, 20.0, 5)], [(1, 2.0, 90), (2, 6.0, 20)]
    null = pairs.fit_null(items, baskets)
    x = np.array([null.item_x[c] for c, _, _ in items])
    p = np.outer(x, null.basket_y) / (1 + np.outer(x, null.basket_y))
    assert p @ null.basket_n == pytest.approx([1, 5, 20], rel=1e-3)
    assert p.T @ np.array([50, 30, 5]) == pytest.approx([2, 6], rel=1e-3)


def exact_tail(q, n, count):
    law = np.array([1.0])
    for qi, ni in zip(q, n, strict=True):
        for _ in range(int(ni)):
            law = np.convolve(law, [1 - qi, qi])
    return law[count:].sum()


def test_tail_against_the_exact_law():
    null = pairs.Null({1: 0.3, 2: 1.5}, np.array([0.2, 0.8, 3.0]), np.array([120.0, 60.0, 8.0]))
    for a, b in ((1, 1), (1, 2), (2, 2)):
        xa, xb, y = null.item_x[a], null.item_x[b], null.basket_y
        q = xa * y / (1 + xa * y) * xb * y / (1 + xb * y)
        mean = (q * null.basket_n).sum()
        for count in {1, int(mean), int(mean) + 1, int(mean) + 4, int(mean) + 12, 30}:
            expected, log_p = pairs.upper_tail(null, np.array([a]), np.array([b]), np.array([count]))
            exact = np.log10(exact_tail(q, null.basket_n, count))
            assert expected[0] == pytest.approx(mean)
            assert log_p[0] == pytest.approx(exact, abs=0.06 + 0.01 * abs(exact))


def test_planted_pair_stands_out(spark):
    rng = random.Random(8)
    rows = [(o, rng.randint(0, 80)) for o in range(800) for _ in range(4)] + [(o, p) for o in range(0, 30) for p in (901, 902)]
    baskets = pairs.Baskets.of(frame(spark, rows), "o", "p")
    rated = pairs.surprise(baskets, pairs.pair_counts(baskets, 3)).where("log10_q < -2").collect()
    assert [(r.item_a, r.item_b) for r in rated] == [(901, 902)]


def test_rare_pairs_are_rated_and_all_that_met_are_ranked(spark, tmp_path):
    rng = random.Random(8)
    rows = [(o, rng.randint(0, 80)) for o in range(800) for _ in range(4)] + [(o, p) for o in range(8) for p in (901, 902)] + [(o, p) for o in range(100, 130) for p in (903, 904)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/tpch_lineitem.parquet")
    found = {(r.partkey_a, r.partkey_b): r for r in together.p5_surprise(spark, str(tmp_path)).collect()}
    assert {(901, 902), (903, 904)} <= set(found)
    assert found[901, 902].n_ab == 8

    baskets = pairs.Baskets.of(frame(spark, rows), "o", "p")
    rated = pairs.surprise(baskets, pairs.pair_counts(baskets)).collect()
    assert len(rated) == len(brute(rows))
    n_items = len({p for _, p in rows})
    log_p = np.array(sorted(-min(int(-r.log10_p * pairs.STEPS), pairs.STEPS * pairs.DECADES) / pairs.STEPS for r in rated))
    raw = log_p + np.log10(n_items * (n_items - 1) / 2) - np.log10(np.searchsorted(log_p, log_p, side="right"))
    want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 0.0)
    assert sorted(r.log10_q for r in rated) == pytest.approx(want.tolist())
