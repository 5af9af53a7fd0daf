import pytest
from pyspark.sql import functions as F

from keytally.operators import snapshots as s
from keytally.operators.resume import resume, snapshot_edit_resume, state_after
from keytally.operators.versions import SnapshotVersions
from keytally.session import work_dir

STATE = "key string, n bigint"
ALL_KEYS = ["a", "B", "é", "~", "z", "m"]


def as_dict(df):
    return {r.key: r.n for r in df.collect()}


@pytest.mark.parametrize("size", [0, 1, 4, 5, 6])
def test_edit_last_n(spark, size):
    before = {k: i + 1 for i, k in enumerate(ALL_KEYS[:size])}
    snapshot = spark.createDataFrame(list(before.items()), STATE)
    last = sorted(before, key=lambda k: k.encode())[-5:]
    edited = s.edit_last_n(snapshot)
    assert as_dict(edited) == {k: 0 if k in last else n for k, n in before.items()}
    assert edited.schema["n"].dataType == snapshot.schema["n"].dataType
    assert tuple(s.edit_report(snapshot).first()) == (size, min(5, size))
    assert s.snapshot_diff(snapshot, edited).count() == min(5, size)


def test_edit_counts_a_null_key_as_the_first(spark):
    snapshot = spark.createDataFrame([(None, 4), ("a", 5), ("b", 6)], STATE)
    assert as_dict(s.edit_last_n(snapshot, 2)) == {None: 4, "a": 0, "b": 0}
    assert as_dict(s.edit_last_n(snapshot, 3)) == {None: 0, "a": 0, "b": 0}
    assert as_dict(s.edit_last_n(snapshot, s.BROADCAST_KEYS + 1)) == {None: 0, "a": 0, "b": 0}


def test_suffix_last(spark):
    snapshot = spark.createDataFrame([("a", "1"), ("zzy", "3"), ("B", "2")], "key string, value string")
    got = {r.key: r.value for r in s.suffix_last(snapshot).collect()}
    assert got == {"a": "1", "zzy": "3_modified", "B": "2"}


def test_order_is_by_bytes(spark):
    snapshot = spark.createDataFrame([(k, 1) for k in ALL_KEYS], STATE)
    by_bytes = sorted(ALL_KEYS, key=lambda k: k.encode())
    assert [r.key for r in s.in_key_order(snapshot).collect()] == by_bytes
    assert [r.key for r in s.tail(snapshot, 2).collect()] == by_bytes[:-3:-1]
    assert s.last_record(snapshot).first().key == "é"


def test_tail_is_a_bounded_heap(spark):
    plan = s.tail(spark.createDataFrame([("a", 1)], STATE))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_diff(spark):
    before = spark.createDataFrame([("same", 1), ("changed", 2), ("gone", 3), (None, 4)], STATE)
    after = spark.createDataFrame([("same", 1), ("changed", 5), ("new", 6), (None, 7)], STATE)
    got = {tuple(r) for r in s.snapshot_diff(before, after).collect()}
    assert got == {("changed", 2, 5), ("gone", 3, None), ("new", None, 6), (None, 4, 7)}
    assert s.snapshot_diff(before, before).count() == 0


def test_versions_are_never_replaced(spark):
    versions = SnapshotVersions(spark, work_dir(spark, "test-versions"))
    snapshot = spark.createDataFrame([(k, 1) for k in ALL_KEYS], STATE)
    stored = versions.write(snapshot, "state", 0)
    versions.write(s.edit_last_n(stored), "state", 1)
    with pytest.raises(FileExistsError, match="there already"):
        versions.write(snapshot, "state", 1)
    assert as_dict(versions.read("state", 0)) == as_dict(snapshot)
    assert sum(as_dict(versions.read("state", 1)).values()) == 1
    assert {r.version for r in versions.read_all("state").collect()} == {0, 1}
    in_files = versions.read("state", 0).groupBy(F.input_file_name()).agg(F.collect_list("key").alias("k"))
    assert all(r.k == sorted(r.k, key=lambda k: k.encode()) for r in in_files.collect())


def test_a_failed_write_can_be_repeated_and_is_never_seen(spark):
    root = work_dir(spark, "test-failed-versions")
    versions = SnapshotVersions(spark, root)
    snapshot = spark.createDataFrame([(k, 1) for k in ALL_KEYS], STATE)
    versions.write(snapshot, "state", 0)
    broken = snapshot.withColumn("n", F.when(F.col("key") < "a", F.col("n")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        versions.write(broken, "state", 1)
    # All is written, but the writer is lost before it commits.
    commit, versions._commit = versions._commit, lambda *given: (_ for _ in ()).throw(RuntimeError("gone"))
    with pytest.raises(RuntimeError, match="gone"):
        versions.write(snapshot, "state", 1)
    versions._commit = commit
    reader = SnapshotVersions(spark, root)
    assert reader.versions("state") == [0] and {r.version for r in reader.read_all("state").collect()} == {0}
    with pytest.raises(FileNotFoundError):
        reader.read("state", 1)
    left = reader.abandoned("state")
    assert len(left) in (1, 2)
    assert as_dict(versions.write(s.edit_last_n(snapshot), "state", 1)) == as_dict(s.edit_last_n(snapshot))
    assert reader.versions("state") == [0, 1] and reader.abandoned("state") == left
    assert reader.read_all("state").groupBy("version").count().collect() == reader.read_all("state").groupBy("version").count().collect()
    assert sum(r["count"] for r in reader.read_all("state").groupBy("version").count().collect()) == 2 * len(ALL_KEYS)


def test_no_version_yet(spark):
    versions = SnapshotVersions(spark, work_dir(spark, "test-no-versions"))
    assert versions.versions("state") == [] and versions.abandoned("state") == []
    for read in (lambda: versions.read("state", 0), lambda: versions.read_all("state")):
        with pytest.raises(FileNotFoundError):
            read()


def test_resume(spark):
    state = spark.createDataFrame([("old", 4), ("both", 2)], STATE)
    rows = spark.createDataFrame([(10, "both"), (11, "new"), (12, "both")], "seq bigint, key string")
    got = sorted((r.seq, r.key, r.n) for r in resume(state, rows).collect())
    assert got == [(10, "both", 3), (11, "new", 1), (12, "both", 4)]
    assert as_dict(state_after(state, rows)) == {"old": 4, "both": 4, "new": 1}


def test_snapshot_edit_resume(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "seq bigint, key string")
    got = snapshot_edit_resume(rows, 5, rows.filter("seq > 5"), lambda snap: s.edit_last_n(snap, 1))
    assert sorted((r.seq, r.key, r.n) for r in got.collect()) == [
        (6, "a", 4), (7, "b", 1), (8, "a", 5), (9, "b", 2)
    ]
