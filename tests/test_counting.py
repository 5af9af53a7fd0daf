import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytally.operators.checks import broken_runs, repeated_keys
from keytally.operators.counting import (
    emitted_counts,
    expand_ranges,
    final_count,
    in_stretches,
    merge_state,
    running_count,
    running_count_by_window,
    typed_pairs,
)

SCHEMA = "seq bigint, key string"


def expected(rows, base=()):
    seen = Counter(dict(base))
    result = []
    for seq, key in sorted(rows):
        seen[key] += 1
        result.append((seq, key, seen[key]))
    return sorted(result, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("seq", "key", "n").collect()), key=str)


def skewed(seed, size=600):
    rng = random.Random(seed)
    keys = ["a", "b", "é", "", None, "="]
    return [(i, "hot" if rng.random() < 0.4 else rng.choice(keys)) for i in rng.sample(range(3 * size), size)]


CASES = {
    "empty": [],
    "one key": [(i, "k") for i in range(50)],
    "all distinct": [(i, f"k{i}") for i in range(50)],
    "null key": [(0, None), (1, "a"), (2, None), (3, None)],
    "skewed": skewed(1),
}


LONG_OR_SHORT = [1, 8, 40, 1 << 20]


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("stretch_rows", LONG_OR_SHORT)
def test_running_count(spark, name, stretch_rows):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = running_count(df, stretch_rows=stretch_rows)
    assert counted.columns == ["seq", "key", "n"]
    assert collected(counted) == expected(rows)
    assert broken_runs(counted).count() == 0
    assert dict(counted.dtypes)["n"] == "bigint"


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("stretch_rows, most", [(8, 100), (8, 0), (1 << 20, 100)])
@pytest.mark.parametrize("partitions", [1, 5])
def test_running_count_from_state(spark, monkeypatch, seed, stretch_rows, most, partitions):
    monkeypatch.setattr("keytally.operators.counting.BROADCAST_KEYS", most)
    rows = skewed(seed, 200)
    base = {"hot": 10, "a": 3, None: 7, "only in state": 5}
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    state = spark.createDataFrame(list(base.items()), "key string, n bigint")
    counted = running_count(df, initial=state, stretch_rows=stretch_rows)
    assert collected(counted) == expected(rows, base.items())
    assert broken_runs(counted, initial=state).count() == 0


def test_columns_are_the_same_at_every_size(spark):
    df = spark.range(400).select(
        (F.col("id") % 20).alias("doc"), (F.col("id") % 3).alias("key"), F.floor(F.col("id") / 20).alias("pos"), F.lit("x").alias("v")
    )
    state = spark.createDataFrame([(0, 0)], "key bigint, n bigint")
    plain = running_count_by_window(df, seq=["doc", "pos"])
    for given in ({}, {"stretch_rows": 16}, {"initial": state}, {"initial": state, "stretch_rows": 16}):
        counted = running_count(df, seq=["doc", "pos"], **given)
        assert counted.schema.simpleString() == plain.schema.simpleString()
        assert counted.exceptAll(plain).count() == 0 and counted.count() == 400


KEYS = {
    "boolean": "id % 5 < 4",
    "double": "if(id % 5 < 4, 1.0E10, -0.5)",
    "timestamp": "timestamp_seconds(if(id % 5 < 4, 0, id))",
    "binary": "cast(if(id % 5 < 4, 'k', cast(id as string)) as binary)",
    "struct<a:bigint,b:string>": "if(id % 5 < 4, named_struct('a', 1L, 'b', null), named_struct('a', id, 'b', 'x'))",
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_keys_of_any_type(spark, kind):
    df = spark.range(600).selectExpr("id as seq", f"{KEYS[kind]} as key", "'after' as v")
    assert df.schema["key"].dataType.simpleString() == kind
    state = df.limit(1).selectExpr("key", "100L as n")
    plain = running_count_by_window(df)
    split = running_count(df, stretch_rows=32)
    assert split.exceptAll(plain).count() == 0 and split.count() == 600
    lifted = running_count(df, initial=state, stretch_rows=32)
    assert {r["n"] - r["seq"] for r in lifted.filter("seq < 4").collect()} == {101}
    assert lifted.count() == 600


@pytest.mark.parametrize("seq", ["id", "id * 1000", "if(id = 7, 1000000000000000000L, id)", "if(id % 2 = 0, id, id * id * id)", "pow(2.0, id % 20) + id / 1e6"])
def test_stretches_are_cut_where_the_rows_are(spark, seq):
    df = spark.range(20_000).selectExpr(f"{seq} as seq", "if(id % 3 > 0, 'hot', cast(id as string)) as key")
    sizes = [r["count"] for r in in_stretches(df, 20_000, "key", ["seq"]).groupBy("_stretch").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8


def test_a_row_costs_the_same_in_many_stretches(spark):
    """Nothing is held against a list of cuts: no join or array in the plan of a long key's rows."""
    df = spark.range(4_000).select(F.col("id").alias("seq"), F.lit("k").alias("key"))
    plan = running_count(df, stretch_rows=8)._jdf.queryExecution().optimizedPlan().toString()
    long_side = plan[plan.rindex("Union") :]
    assert "Join" not in long_side and "lambda" not in plan


@pytest.mark.parametrize("stretch_rows", [1 << 20, 100])
def test_a_task_numbers_no_more_rows_of_a_larger_input(spark, monkeypatch, stretch_rows):
    """Short keys and stretches of long ones alike; the session's number of shuffle partitions stays."""
    monkeypatch.setattr("keytally.operators.counting.TASK_ROWS", 200)
    monkeypatch.setattr("keytally.operators.counting.RANGE_STRETCH_ROWS", 50)
    for size in (4_000, 16_000):
        df = spark.range(size).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("key"))
        counted = running_count(df, stretch_rows=stretch_rows)
        tasks = counted.filter("key <> 'hot'" if stretch_rows > size else "key = 'hot'").groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in tasks.collect()) < 600
        assert counted.exceptAll(running_count_by_window(df)).count() == 0 and counted.count() == size


def test_repeated_state_of_a_key_adds_up(spark):
    df = spark.createDataFrame([(i, "k") for i in range(20)] + [(20, "one")], SCHEMA)
    state = spark.createDataFrame([("k", 5), ("k", 6), ("one", 1), ("one", 2)], "key string, n bigint")
    for stretch_rows in (4, 1 << 20):
        got = {(r.key, r.n) for r in running_count(df, initial=state, stretch_rows=stretch_rows).collect()}
        assert got == {("k", n) for n in range(12, 32)} | {("one", 4)}


def test_text_and_null_orders(spark):
    rows = [(None if i == 5 else f"{i:05d}", "k" if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "seq string, key string")
    assert collected(running_count(df, stretch_rows=16)) == collected(running_count_by_window(df))


def test_hot_rows_are_spread(spark):
    """One key with all rows does not end up in one task."""
    df = spark.range(4000).select(F.col("id").alias("seq"), F.lit("k").alias("key"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = running_count(df, stretch_rows=100)
        sizes = counted.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["count"] for r in sizes) < 2000


@pytest.mark.parametrize("name", list(CASES))
def test_emitted_counts(spark, name):
    rows = CASES[name]
    got = emitted_counts(spark.createDataFrame(rows, SCHEMA))
    assert Counter((r.key, r.n) for r in got.collect()) == Counter((k, n) for _, k, n in expected(rows))


def test_emitted_counts_from_state(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], SCHEMA)
    state = spark.createDataFrame([("a", 5), ("z", 9)], "key string, n bigint")
    got = {(r.key, r.n) for r in emitted_counts(df, initial=state).collect()}
    assert got == {("a", 6), ("a", 7), ("b", 1)}


def test_expand_ranges_in_pieces(spark):
    ranges = spark.createDataFrame([("a", 3, 25), ("b", 0, 0), ("c", 9, 1)], "key string, base bigint, cnt bigint")
    got = sorted((r.key, r.n) for r in expand_ranges(ranges, piece=10).collect())
    assert got == [("a", n) for n in range(4, 29)] + [("c", 10)]


def test_long_ranges_are_cut_twice(spark, monkeypatch):
    monkeypatch.setattr("keytally.operators.counting.SPREAD_ROWS", 50)
    ranges = spark.createDataFrame([("a", 3, 1234), ("b", 0, 50)], "key string, base bigint, cnt bigint")
    got = sorted((r.key, r.n) for r in expand_ranges(ranges, piece=7).collect())
    assert got == [("a", n) for n in range(4, 1238)] + [("b", n) for n in range(1, 51)]


def test_final_count_and_merge(spark):
    rows = skewed(6)
    half = len(rows) // 2
    parts = [final_count(spark.createDataFrame(part, SCHEMA)) for part in (rows[:half], rows[half:])]
    merged = merge_state(*parts)
    assert {r.key: r.n for r in merged.collect()} == Counter(k for _, k in rows)
    assert repeated_keys(merged).count() == 0
    assert merged.agg(F.sum("n")).first()[0] == len(rows)


def test_typed_pairs_are_string_and_int(spark):
    df = spark.createDataFrame([(7, 1)], "key bigint, n bigint")
    assert typed_pairs(df).dtypes == [("key", "string"), ("n", "int")]
    too_large = spark.createDataFrame([("k", 1 << 31)], "key string, n bigint")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        typed_pairs(too_large).collect()


def test_checks_find_broken_runs(spark):
    bad = spark.createDataFrame(
        [("gap", 1), ("gap", 3), ("twice", 1), ("twice", 1), ("good", 1), ("good", 2), ("late", 2)], "key string, n bigint"
    )
    assert {r.key for r in broken_runs(bad).collect()} == {"gap", "twice", "late"}
