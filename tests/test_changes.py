import pytest
from pyspark.sql import functions as F

from quern.operators import changes
from quern.operators.versions import latest_version
from quern.sources.snapshots import CommitConflict, SnapshotStore, TableLocked

SCHEMA = "k int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_checks_table_and_batch(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], SCHEMA)
    batch = spark.createDataFrame([(1, "x"), (2, "b"), (2, "c"), (None, "m"), (None, "m")], SCHEMA)
    with pytest.raises(changes.DuplicateKey):
        changes.insert_unique(target, batch, ["k"], ["v"])
    assert rows(changes.insert_unique(target, batch, ["k"], ["v"], ignore=True)) == sorted([(1, "a"), (None, "n"), (2, "b"), (None, "m"), (None, "m")], key=repr)
    assert rows(changes.rejected(target, batch, ["k"], ["v"])) == [(1, "x"), (2, "c")]


def test_numbers_are_dense(spark):
    target = spark.createDataFrame([(10, "a")], SCHEMA)
    new = spark.createDataFrame([(None, f"{i:03d}") for i in range(50)] + [(12, "x")], SCHEMA)
    got = rows(changes.with_auto_increment(target, new.select(F.col("k").cast("long").alias("k"), "v"), "k", ["v"]))
    assert sorted(k for k, _ in got) == [12, *range(13, 63)]


def test_numbers_of_a_large_batch_are_dense(spark):
    target = spark.createDataFrame([(10, "a")], SCHEMA).select(F.col("k").cast("long").alias("k"), "v", F.lit("").alias("w"))
    n = 60_000  # wide rows: more than one partition when read whole, one when only v is
    new = spark.range(n).select(F.lit(None).cast("long").alias("k"), F.format_string("%06d", "id").alias("v"), F.concat(*(F.sha2(F.concat(F.col("id"), F.lit(f"/{i}")), 256) for i in range(4))).alias("w"))
    got = sorted((r.v, r.k) for r in changes.with_auto_increment(target, new, "k", ["v"]).select("v", "k", "w").collect())
    assert got == [(f"{i:06d}", 11 + i) for i in range(n)]


def test_null_conditions_change_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], SCHEMA)
    assert rows(changes.delete_where(df, F.col("k") == 1)) == [(None, "b")]
    assert rows(changes.update_where(df, F.col("k") == 1, {"v": F.lit("z")})) == sorted([(1, "z"), (None, "b")], key=repr)


def test_versions(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d"), (None, 1, "e"), (None, 1, "e"), (None, 1, "f")], "k int, at int, v string")
    assert rows(latest_version(df, ["k"], "at", ["v"])) == sorted([(1, 2, "c"), (2, None, "d"), (None, 1, "e"), (None, 1, "f")], key=repr)
    assert latest_version(df.limit(0), ["k"], "at", ["v"]).isEmpty()


def test_first_writer_wins(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(5))
    one, two = store.begin("t"), store.begin("t")
    one.stage(spark.range(6))
    two.stage(spark.range(7))
    held = store.read("t")
    one.commit()
    with pytest.raises(CommitConflict):
        two.commit()
    assert held.count() == 5 and store.read("t").count() == 6 and store.read("t", 1).count() == 5
    assert store.versions("t") == [1, 2]
    store.vacuum("t")
    assert store.versions("t") == [2] and store.read("t").count() == 6


def test_failed_change_leaves_nothing(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(5))
    store.create("t_more", spark.range(3))
    with pytest.raises(RuntimeError), store.begin("t") as change:
        change.stage(spark.range(1))
        raise RuntimeError
    assert store.read("t").count() == 5
    store.rename("t", "u")
    assert store.tables() == ["t_more", "u"]
    assert store.drop("u") and store.tables() == ["t_more"]


def test_upsert_keeps_rows_with_a_null_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], SCHEMA)
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (3, "c"), (None, "m"), (None, "m"), (None, "o")], SCHEMA)
    got = rows(changes.upsert(target, batch, ["k"], ["v"]))
    assert got == sorted([(1, "y"), (2, "b"), (3, "c"), (None, "n"), (None, "m"), (None, "m"), (None, "o")], key=repr)
    assert rows(changes.upsert(target, batch.limit(0), ["k"], ["v"])) == rows(target)


def test_numbers_with_ties_and_repeats(spark):
    target = spark.createDataFrame([(10, "a")], SCHEMA).select(F.col("k").cast("long").alias("k"), "v")
    new = spark.createDataFrame([(None, "same")] * 40 + [(None, "other")] * 5, SCHEMA).select(F.col("k").cast("long").alias("k"), "v")
    got = rows(changes.with_auto_increment(target, new.repartition(5), "k", ["v"]))
    assert sorted(k for k, _ in got) == list(range(11, 56))
    assert sorted(v for k, v in got if k <= 15) == ["other"] * 5


def test_vacuum_leaves_a_writer_at_work_alone(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(5))
    change = store.begin("t")
    change.stage(spark.range(6))
    store.vacuum("t")
    change.commit()
    assert store.read("t").count() == 6 and not [n for n in store._names("t") if n.startswith("_intent")]
    other = store.begin("t")
    other.stage(spark.range(7))
    store.vacuum("t", stale_seconds=-1)  # its writer counts as gone
    with pytest.raises(CommitConflict):
        other.commit()
    assert store.read("t").count() == 6


def test_manifests_appear_whole_and_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(5))
    (tmp_path / "store" / "t" / "_manifest-2.abc.tmp").write_text("{")  # a writer died before the name was given
    assert store.versions("t") == [1] and store.read("t").count() == 5
    with store.begin("t") as change:
        change.stage(spark.range(6))
    assert store.read("t").count() == 6
    assert not store._write_new(f"{store._table('t')}/_manifest-2", {}) and store.read("t").count() == 6
    store.create("t", spark.range(3))  # the old rows stay readable until the new ones are there
    assert store.versions("t") == [1, 2, 3] and store.read("t", 2).count() == 6 and store.read("t").count() == 3


def test_exclusive_writers_wait(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(5))
    one = store.begin("t", exclusive=True)
    with pytest.raises(TableLocked):
        store.begin("t", exclusive=True, wait_seconds=0.1)
    one.rollback()
    with store.begin("t", exclusive=True) as two:
        two.insert(spark.range(2))
    store.begin("t", exclusive=True).rollback()
    assert store.read("t").count() == 7


def keyed(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))


def test_changes_by_key_rewrite_only_their_files(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", keyed(spark, 1000), ["k"], partitions=10)
    before = {f["path"] for f in store.manifest("t")["files"]}
    assert len(before) == 10
    with store.begin("t") as change:
        change.upsert(spark.createDataFrame([(505, "new")], "k long, v string"), ["v"])
    after = {f["path"] for f in store.manifest("t")["files"]}
    assert len(before & after) == 9 and change.written == 1
    assert store.read("t").where("k = 505").first().v == "new" and store.read("t").count() == 1000
    with store.begin("t") as change:
        change.delete_keys(spark.createDataFrame([(1,), (2,), (5000,), (None,)], "k long"))
        change.update_where(F.col("k") == 999, {"v": F.lit("last")})
        change.insert(spark.createDataFrame([(None, "null key"), (2000, "far")], "k long, v string"))
    assert store.read("t").count() == 1000 and change.written <= 4
    assert store.read("t").where("k = 999").first().v == "last" and store.read("t").where("k is null").count() == 1
    with store.begin("t") as change:
        change.delete_where(F.col("k") >= 900)
    assert store.read("t").count() == 899
    store.begin("t").commit()  # nothing staged, nothing new
    store.vacuum("t")
    assert store.read("t").count() == 899
    files = len(store.manifest("t")["files"])
    assert store.compact("t") == files - len(store.manifest("t")["files"]) > 0
    assert sorted(r.k for r in store.read("t").where("k is not null").collect()) == sorted({*range(900)} - {1, 2})


def test_statistics_are_kept_until_due(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.create("t", spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g")), ["k"])
    wanted = {"by_g": ["g", "k"]}
    first = store.statistics("t", wanted, now=0.0)
    assert first["rows"] == 100 and abs(first["rows_per_key"]["by_g.1"] - 20) <= 1 and abs(first["rows_per_key"]["by_g.2"] - 1) < 0.1
    with store.begin("t") as change:
        change.insert(spark.range(50).select((F.col("id") + 1000).alias("k"), F.lit(7).cast("long").alias("g")))
    assert store.statistics("t", wanted, now=30.0) == first  # much has changed, but just now
    assert store.statistics("t", wanted, now=61.0)["rows"] == 150
    assert store.statistics("t", wanted, now=2000.0)["taken_at"] == 61.0
    assert store.statistics("t", wanted, now=3100.0)["taken_at"] == 3100.0
