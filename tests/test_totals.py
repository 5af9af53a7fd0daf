import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytally.operators.snapshots import snapshot_diff
from keytally.streaming import totals

SCHEMA = "seq bigint, key string"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def drop(spark, root, keys, name="in"):
    spark.createDataFrame(list(enumerate(keys)), SCHEMA).coalesce(2).write.mode("append").parquet(f"{root}/{name}")
    return spark.readStream.schema(SCHEMA).parquet(f"{root}/{name}")


def run(rows, root, name="", initial=None):
    return totals.run_totals(rows, f"{root}/out{name}", f"{root}/checkpoint{name}", initial, partitions=3)


def emitted(base, keys):
    seen, found = Counter(dict(base)), Counter()
    for key in keys:
        seen[key] += 1
        found[key, seen[key]] += 1
    return found


def pairs(df):
    return Counter(tuple(r) for r in df.collect())


FIRST = ["a", "b", None, "a", "é", ""] * 40 + ["once"]
SECOND = ["a", None, "new"] * 30


def test_drops_count_on_and_states_can_be_read(spark, root):
    run(drop(spark, root, FIRST), root)
    counted = run(drop(spark, root, SECOND), root)
    assert pairs(counted) == emitted({}, FIRST + SECOND)
    states = [totals.read_totals(spark, f"{root}/checkpoint", batch) for batch in (0, 1, None)]
    assert [dict(s.collect()) for s in states] == [Counter(FIRST), Counter(FIRST + SECOND), Counter(FIRST + SECOND)]
    changed = totals.changed_totals(spark, f"{root}/checkpoint", 0, 1)
    assert pairs(changed) == pairs(snapshot_diff(states[0], states[1]))
    assert {r["key"]: r["n_before"] for r in changed.collect()} == {"a": 80, None: 40, "new": None}


def test_changes_over_several_batches(spark, root):
    for keys in (["a", "b"], ["a", "c"], ["b"], ["c", "d", "a"]):
        run(drop(spark, root, keys), root)
    for before in range(3):
        for after in range(before + 1, 4):
            states = [totals.read_totals(spark, f"{root}/checkpoint", batch) for batch in (before, after)]
            assert pairs(totals.changed_totals(spark, f"{root}/checkpoint", before, after)) == pairs(snapshot_diff(*states))


def test_starts_from_a_snapshot_once(spark, root):
    base = {"a": 10, None: 3, "zero": 0, "quiet": 7}
    state = spark.createDataFrame(list(base.items()), "key string, n bigint")
    run(drop(spark, root, FIRST), root, initial=state)
    with pytest.raises(ValueError, match="in use"):
        run(drop(spark, root, []), root, initial=state)
    counted = run(drop(spark, root, ["zero", "a", "quiet"]), root)
    assert pairs(counted) == emitted(base, FIRST + ["zero", "a", "quiet"])
    assert totals.read_totals(spark, f"{root}/checkpoint").filter("key = 'quiet'").first()["n"] == 8
    changed = {r["key"]: r["n_before"] for r in totals.changed_totals(spark, f"{root}/checkpoint", 0, 1).collect()}
    assert changed == {"zero": 0, "a": 90, "quiet": 7}


def test_a_batch_that_is_run_again_writes_once(spark, root):
    """The second micro-batch fails after its output is written; the restart writes the same folder."""
    run(drop(spark, root, FIRST), root)
    stream, ranges = drop(spark, root, SECOND), totals.expand_ranges

    def broken(*given, **named):
        ranges(*given, **named).write.mode("overwrite").parquet(f"{root}/out/batch=1")
        raise RuntimeError("lost")

    totals.expand_ranges = broken
    try:
        with pytest.raises(Exception, match="lost"):
            run(stream, root)
    finally:
        totals.expand_ranges = ranges
    assert pairs(run(stream, root)) == emitted({}, FIRST + SECOND)


def test_nothing_arrives(spark, root):
    assert run(drop(spark, root, []), root).count() == 0
    assert totals.read_totals(spark, f"{root}/checkpoint").count() == 0


def test_keys_are_combined_before_the_state(spark, monkeypatch):
    """A task hands on one row per key, however many batches it has."""
    monkeypatch.setattr(totals, "_HELD_ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        given = spark.range(500).coalesce(1).select(
            (F.col("id") % 9).cast("string").alias("key"), F.lit(None).cast("timestamp").alias("at"), F.lit(1).cast("bigint").alias("weight"), F.lit(1).cast("bigint").alias("brought")
        )
        rows = given.mapInArrow(totals._combine_all, totals._COMBINED).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 9 and sum(r["weight"] for r in rows) == 500


def test_a_task_combines_a_share_of_its_partitions_keys(spark, root, monkeypatch):
    """What Python holds of a micro-batch is far less than a partition of the state, and repeated keys are combined before the shuffle."""
    monkeypatch.setattr(totals, "_HELD_ROWS", 100)
    monkeypatch.setattr(totals, "expand_ranges", lambda ranges, **_: ranges)
    combine_all = totals._combine_all

    def held(batches):
        rows = list(batches)
        if rows:
            open(f"{marks}/{uuid.uuid4().hex}", "w").write(str(sum(b.num_rows for b in rows)))
        yield from combine_all(rows)

    marks = root.removeprefix("file://") + "/marks"
    os.makedirs(marks)
    monkeypatch.setattr(totals, "_combine_all", held)
    totals.start_totals(drop(spark, root, [str(i % 1600) for i in range(4800)]), f"{root}/out", f"{root}/checkpoint", partitions=2).awaitTermination()
    marked = [int(open(f"{marks}/{name}").read()) for name in os.listdir(marks)]
    assert len(marked) > 16 and max(marked) < 600
    assert totals.read_totals(spark, f"{root}/checkpoint").agg(F.sum("n"), F.count("n")).first() == (4800, 1600)


def test_records_are_combined_over_several_batches(spark):
    """Before the shuffle a key is handed on once for many Arrow batches, not once for each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        one = F.lit(1).cast("bigint")
        given = spark.range(500).coalesce(1).select((F.col("id") % 9).cast("string").alias("key"), one.alias("weight"), one.alias("brought"))
        rows = given.mapInArrow(totals._combine, "key string, weight bigint, brought bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 9 and sum(r["weight"] for r in rows) == 500


def test_state_is_written_and_read_without_counting_its_keys(spark, root, monkeypatch):
    """The number of keys would cost a look-up for each write; -1 says that it is not kept."""
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    seen, load = [], type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda self, *a, **b: seen.append(spark.conf.get(name)) or load(self, *a, **b))
    query = totals.start_totals(drop(spark, root, FIRST), f"{root}/out", f"{root}/checkpoint", partitions=3)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < len(set(FIRST))
    assert dict(totals.read_totals(spark, f"{root}/checkpoint").collect()) == Counter(FIRST)
    assert seen == ["false"] and spark.conf.get(name, None) in (None, "true")
