"""Streams give what the batch forms give."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytally.operators.checks import broken_runs
from keytally.operators.counting import emitted_counts, final_count, merge_state
from keytally.operators.snapshots import edit_last_n
from keytally.session import work_dir
from keytally.streaming import counts
from keytally.streaming.state import read_snapshot, snapshot_metadata

SCHEMA = "seq bigint, key string"


def skewed(seed, size=500):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "é", ""])) for i in range(size)]


def drop(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(path)


def stream(spark, path, per_trigger=None):
    reader = spark.readStream.schema(SCHEMA)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def pairs(df):
    return Counter((r.key, r.n) for r in df.select("key", "n").collect())


def test_counts_over_many_small_batches(spark):
    root = work_dir(spark, "test-stream")
    rows = skewed(1)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{root}/in")
    counted = counts.stream_counts(stream(spark, f"{root}/in", per_trigger=1))
    got = counts.run(counted, f"{root}/out", f"{root}/ck")
    batch = spark.createDataFrame(rows, SCHEMA)
    assert pairs(got) == pairs(emitted_counts(batch))
    assert broken_runs(got).count() == 0
    assert pairs(read_snapshot(spark, f"{root}/ck")) == pairs(final_count(batch))
    stores = [tuple(r) for r in snapshot_metadata(spark, f"{root}/ck").collect()]
    assert stores == [("transformWithStateInPySparkExec", "default", "count", 0, 3)]


def test_restart_and_older_snapshot(spark):
    root = work_dir(spark, "test-restart")
    rows = skewed(2)
    drop(spark, rows[:300], f"{root}/in")
    counted = counts.stream_counts(stream(spark, f"{root}/in"))
    first = counts.run(counted, f"{root}/out", f"{root}/ck")
    assert first.count() == 300
    drop(spark, rows[300:], f"{root}/in")
    both = counts.run(counted, f"{root}/out", f"{root}/ck")
    assert pairs(both) == pairs(emitted_counts(spark.createDataFrame(rows, SCHEMA)))
    older = read_snapshot(spark, f"{root}/ck", batch_id=0)
    assert pairs(older) == pairs(final_count(spark.createDataFrame(rows[:300], SCHEMA)))


def test_resume_from_edited_snapshot(spark):
    root = work_dir(spark, "test-resume")
    first, second = skewed(3), skewed(4, 200)
    state = edit_last_n(final_count(spark.createDataFrame([*first, (0, "only in state")], SCHEMA)), 2)
    drop(spark, second[:100], f"{root}/in")
    drop(spark, second[100:], f"{root}/in")
    rows = stream(spark, f"{root}/in", per_trigger=2)
    got = counts.resume_from_snapshot(rows, state, f"{root}/out", f"{root}/ck")
    new = spark.createDataFrame(second, SCHEMA)
    assert pairs(got) == pairs(emitted_counts(new, initial=state))
    assert broken_runs(got, initial=state).count() == 0
    # Keys without new records stay in the next snapshot.
    assert pairs(read_snapshot(spark, f"{root}/ck")) == pairs(merge_state(state, final_count(new)))
    with pytest.raises(ValueError, match="in use"):
        counts.resume_from_snapshot(rows, state, f"{root}/out", f"{root}/ck")


def test_live_trigger(spark):
    root = work_dir(spark, "test-live")
    drop(spark, [(0, "a"), (1, "a")], f"{root}/in")
    counted = counts.stream_counts(stream(spark, f"{root}/in"))
    query = counts.start(counted, f"{root}/out", f"{root}/ck", {"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        # A snapshot is read while the query runs on.
        assert pairs(read_snapshot(spark, f"{root}/ck")) == Counter({("a", 2): 1})
        assert query.isActive
        drop(spark, [(2, "a")], f"{root}/in")
        deadline = time.time() + 60
        while time.time() < deadline and query.lastProgress["batchId"] < 1:
            time.sleep(0.5)
        query.processAllAvailable()
    finally:
        query.stop()
    assert pairs(spark.read.parquet(f"{root}/out")) == Counter({("a", 1): 1, ("a", 2): 1, ("a", 3): 1})


def test_session_settings_are_put_back(spark):
    root = work_dir(spark, "test-conf")
    name = next(iter(counts.STATE_CONF))
    before = spark.conf.get(name)
    drop(spark, [(0, "a")], f"{root}/in")
    counts.run(counts.stream_counts(stream(spark, f"{root}/in")), f"{root}/out", f"{root}/ck")
    assert spark.conf.get(name) == before


def test_hot_key_is_combined_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key")).coalesce(1)
    combined = rows.mapInArrow(counts._combine, "key string, cnt bigint")
    got = [tuple(r) for r in combined.collect()]
    assert sum(n for _, n in got) == 20_000
    assert len(got) <= 3
