import datetime as dt
import random
from decimal import Decimal

import pytest

from quern.operators.rolling import EMPTY, WindowQueue, combine, rolling_runs, rolling_totals

DAY0 = dt.date(2020, 1, 1)


def brute(rows, periods):
    out = {}
    for name in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        own = [(d, x) for e, d, x in rows if e == name and d is not None]
        first, last = min(d for d, _ in own), max(d for d, _ in own)
        day = first
        while day <= last + dt.timedelta(days=max(periods) - 1):
            cells = []
            for p in periods:
                inside = [x for d, x in own if x is not None and dt.timedelta(0) <= day - d < dt.timedelta(days=p)]
                cells += [sum(inside, Decimal(0)), len(inside), min(inside, default=None), max(inside, default=None)]
            out[name, day] = cells
            day += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([1, 2, 3, None]), DAY0 + dt.timedelta(days=rng.randint(0, 90)) if rng.random() > 0.05 else None, Decimal(rng.randint(-5000, 90000)) / 100 if rng.random() > 0.1 else None)
        for _ in range(120)
    ]
    rows += rows[:5]  # repeated rows count again
    df = spark.createDataFrame([(*r, "x") for r in rows], "e long, d date, amount decimal(10,2), total_7 string")
    got = {(r.e, r.d): r for r in rolling_totals(df, "e", "d", "amount", (7, 30)).collect()}
    want = brute(rows, (7, 30))
    assert got.keys() == want.keys()
    for k, cells in want.items():
        r = got[k]
        assert [r.total_7, r.count_7, r.min_7, r.max_7, r.total_30, r.count_30, r.min_30, r.max_30] == cells
        assert r.avg_7 == (pytest.approx(float(cells[0]) / cells[1]) if cells[1] else None)


def test_empty_and_all_null(spark):
    schema = "e string, d date, amount int"
    assert rolling_runs(spark.createDataFrame([], schema), "e", "d", "amount").isEmpty()
    only = rolling_totals(spark.createDataFrame([("a", DAY0, None)], schema), "e", "d", "amount", (2,)).collect()
    assert [(r.total_2, r.count_2, r.avg_2) for r in only] == [(0, 0, None), (0, 0, None)]


def test_queue_is_the_fold_of_its_window():
    rng = random.Random(1)
    queue, held = WindowQueue(5), []
    for day in sorted(rng.sample(range(200), 120)):
        x = rng.randint(-9, 9)
        queue.evict(day)
        queue.push(day, (x, 1, x, x))
        held = [(d, v) for d, v in [*held, (day, x)] if d > day - 5]
        total = EMPTY
        for _, v in held:
            total = combine(total, (v, 1, v, v))
        assert queue.total() == total
