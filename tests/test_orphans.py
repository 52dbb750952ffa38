import datetime as dt

from quern.operators.orphans import Reference, change_deltas, dated_ledger, doubtful_cells, ledger, merge_ledgers, orphan_keys, orphan_report, orphan_rows
from quern.operators.skew import join_counted

T0 = dt.datetime(2020, 1, 1)
PARENT = "id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string"
CHILD = "ref long, row long, loaded_at timestamp_ntz, id string"
R = Reference("child", "ref", "parent", "id", "row")


def at(days):
    return None if days is None else T0 + dt.timedelta(days=days)


def brute(children, parents):
    return sorted(
        row for ref, row, t, _ in children if ref is not None and not any(p == ref and a <= t and (b is None or b > t) for p, a, b, _ in parents)
    )


def test_against_brute_force(spark):
    parents = [
        (1, at(0), None, "a"), (1, at(0), None, "a"), (2, at(5), at(9), "b"), (2, at(20), None, "b"), (3, at(1), at(1), "c"), (4, at(8), at(3), "d"),
        (5, at(0), at(10), "e"), (5, at(5), at(60), "e"), (None, at(0), None, "n"), (6, at(0), at(40), "f"), (6, at(35), at(45), "f"),
    ]
    children = [(ref, ref_no * 100 + day, at(day), "x") for ref_no, ref in enumerate([1, 2, 3, 4, 5, 6, 7, None]) for day in range(0, 70, 1)]
    found = orphan_rows([(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), R)])
    assert sorted(r.row_key for r in found.collect()) == brute(children, parents)
    assert sum(r.orphan_rows for r in orphan_report(found).collect()) == len(brute(children, parents))


def test_empty_tables(spark):
    children = spark.createDataFrame([(1, 1, at(0), "x")], CHILD)
    assert orphan_rows([(children, spark.createDataFrame([], PARENT), R)]).count() == 1
    assert orphan_rows([(children.limit(0), spark.createDataFrame([], PARENT), R)]).isEmpty()


def test_ledgers_of_parts_add_up(spark):
    parents = spark.createDataFrame([(i % 7, at(i), at(i + 3) if i % 2 else None, "k") for i in range(20)], PARENT)
    children = spark.createDataFrame([(i % 9 if i % 5 else None, i, at(i), "x") for i in range(40)], CHILD)
    refs = lambda df: change_deltas(df, "ref", "loaded_at", None, "refs")
    have = lambda df: change_deltas(df, "id", "loaded_at", "deleted_at", "exist")
    whole = ledger(refs(children), have(parents))
    early, late = "loaded_at < '2020-01-11'", "loaded_at >= '2020-01-11'"
    parts = merge_ledgers(ledger(refs(children.where(early)), have(parents.where(early))), ledger(refs(children.where(late)), have(parents.where(late))))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert {r.key for r in orphan_keys(whole).collect()} == {7, 8}


def test_hot_keys_and_moments_within_a_day(spark):
    hours = lambda h: T0 + dt.timedelta(hours=h)
    parents = [(1, hours(3 * i), hours(3 * i + 1), "k") for i in range(60)] + [(2, hours(5), None, "k"), (3, None, None, "k")]
    children = [(1, h, hours(h), "x") for h in range(-3, 190)] + [(2, 1000 + h, hours(h), "x") for h in range(12)] + [(3, 2000, hours(1), "x"), (2, 2001, None, "x")]
    found = orphan_rows([(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), R)])
    want = [row for ref, row, t, _ in children if not any(p == ref and None not in (a, t) and a <= t and (b is None or b > t) for p, a, b, _ in parents)]
    assert sorted(r.row_key for r in found.collect()) == sorted(want)


def test_the_ledger_says_what_is_doubtful(spark):
    deltas = lambda rows, name: spark.createDataFrame([(0, k, at(d), n) for k, d, n in rows], f"ref tinyint, key long, at timestamp_ntz, {name} long")
    exist = deltas([(1, 0, 1), (2, 5, 1), (2, 7, -1)], "exist")
    refs = deltas([(1, 3, 1), (2, 4, 1), (2, 5, 1), (2, 6, 1), (2, 7, 1), (2, 9, 2), (3, 1, 1)], "refs")
    dated = dated_ledger(refs, exist)
    assert {(r.key, r.day.day): (r.had_refs, r.had) for r in dated.collect()}[(2, 10)] == (4, 0)
    assert {(r.key, r.day.day): r.verdict for r in doubtful_cells(dated).collect()} == {(2, 5): "all", (2, 8): "mixed", (2, 10): "all", (3, 2): "all"}


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 1), (None, 1)], "k int, i int")
    lookup = spark.createDataFrame([(1, 500, "a"), (2, 1, "b"), (4, 1, "d")], "k int, n long, v string")
    found = join_counted(rows, lookup, ["k"], "n", 502, ["i"], parts=8)
    assert sorted((r.k, r.i, r.v) for r in found.collect()) == sorted([(1, i, "a") for i in range(500)] + [(2, 1, "b")])
    assert found.where("k = 1").select("__salt").distinct().count() == 8
    assert join_counted(rows.limit(0), lookup, ["k"], "n", 0, ["i"]).isEmpty()
