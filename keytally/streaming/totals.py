"""Running counts over a stream of many keys, by Spark's own streaming aggregation.

The state of a key is its total, how many records the last micro-batch that had
the key brought, and since when the key is known. Aggregation reads and writes it
in the JVM, so a key costs no call to Python. What a micro-batch emits for a key
are the counts from ``total - brought + 1`` to ``total``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytally.operators.counting import expand_ranges
from keytally.streaming.counts import AVAILABLE_NOW, path_exists, state_settings

_COMBINED = "key string, weight bigint, brought bigint"
#: Rows that a task holds before it combines them.
_HELD_ROWS = 1 << 18
#: For each partition of the state so many tasks combine a micro-batch's records, each of which holds its keys.
_SPREAD = 16


def _sum(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables, promote_options="default")
    summed = whole.group_by("key", use_threads=False).aggregate([("weight", "sum"), ("brought", "sum")])
    return summed.rename_columns(["key", "weight", "brought"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of every ``_HELD_ROWS`` rows, or a few more."""
    held, rows = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= _HELD_ROWS:
            yield from _sum(held).to_batches()
            held, rows = [], 0
    if held:
        yield from _sum(held).to_batches()


def _combine_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of the task; it holds the task's distinct keys."""
    held, rows, limit = [], 0, _HELD_ROWS
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > limit:
            held = [_sum(held)]
            rows, limit = held[0].num_rows, max(_HELD_ROWS, 2 * held[0].num_rows)
    if held:
        yield from _sum(held).to_batches()


def stream_totals(rows: DataFrame, initial: DataFrame | None = None, key: str = "key", partitions: int | None = None) -> DataFrame:
    """The stream ``(key, base, cnt)``: for each key of a micro-batch its count before and its new records.

    Records are combined in stretches of a task's rows and again after a shuffle by
    key, in ``_SPREAD`` times as many tasks as the state has partitions, so that a micro-batch hands one row per key to the state; what it brought
    is then that with the latest batch time. ``initial`` is a stream ``(key, n)``
    of which the first micro-batch has to hold all; it counts, but emits nothing.
    If the clock was put back between two micro-batches the query fails instead
    of counting wrongly, and can be started again once the clock has caught up.
    """
    number = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("bigint")
    given = rows.select(F.col(key).cast("string").alias("key"), one.alias("weight"), one.alias("brought"))
    if initial is not None:
        held = F.col("n").cast("bigint").alias("weight")
        state = initial.select(F.col(key).cast("string").alias("key"), held, F.lit(0).cast("bigint").alias("brought"))
        given = given.unionByName(state)
    few = given.mapInArrow(_combine, _COMBINED).repartition(number * _SPREAD, "key").mapInArrow(_combine_all, _COMBINED)
    each = few.withColumn("at", F.current_timestamp())
    state = each.groupBy("key").agg(
        F.sum("weight").alias("total"), F.max(F.struct("at", "brought")).alias("last"), F.min("at").alias("since")
    )
    # True of all keys; a value that the result did not use would not be kept in the state.
    state = state.filter(F.col("since") <= F.col("last.at"))
    late = F.raise_error(F.lit("the clock is behind the last micro-batch: start again later"))
    brought = F.when(F.col("last.at") == F.current_timestamp(), F.col("last.brought")).otherwise(late.cast("bigint"))
    return state.select("key", (F.col("total") - brought).alias("base"), brought.alias("cnt"))


def start_totals(
    rows: DataFrame,
    output: str,
    checkpoint: str,
    initial: DataFrame | None = None,
    key: str = "key",
    trigger: dict | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Start writing ``(key, n)`` for every record of ``rows`` below ``output``, a folder for each micro-batch.

    A micro-batch that is run again writes its folder anew, so each record is
    there once. ``initial`` is a table ``(key, n)``, for a new checkpoint only; it
    is kept beside the checkpoint, which a restart reads it from. By default all
    that has arrived is processed and the query ends.
    """
    spark, held = rows.sparkSession, f"{checkpoint}-initial"
    if not path_exists(spark, f"{checkpoint}/offsets"):
        none = spark.createDataFrame([], "key string, n bigint")
        state = none if initial is None else initial.select(F.col(key).cast("string").alias("key"), F.col("n").cast("bigint").alias("n"))
        state.write.mode("overwrite").parquet(held)
    elif initial is not None:
        raise ValueError(f"{checkpoint} is in use: a snapshot only starts a new checkpoint")
    first = spark.readStream.schema("key string, n bigint").parquet(held)
    totals = stream_totals(rows.select(F.col(key).alias("key")), first, partitions=partitions)

    def write(ranges: DataFrame, batch: int) -> None:
        expand_ranges(ranges, partitions=partitions).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    with state_settings(spark, partitions):
        return (
            totals.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW))
            .start()
        )


def run_totals(rows: DataFrame, output: str, checkpoint: str, initial: DataFrame | None = None, key: str = "key", partitions: int | None = None) -> DataFrame:
    """Process all that has arrived and return ``(key, n)`` of everything written so far."""
    start_totals(rows, output, checkpoint, initial, key, partitions=partitions).awaitTermination()
    written = rows.sparkSession.read.schema("key string, n bigint, batch bigint").parquet(output)
    return written.select(F.col("key").alias(key), "n")


def read_totals(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``(key, n)`` as of a finished micro-batch, the last one by default, beside the running query."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    with state_settings(spark, None):
        state = reader.load(checkpoint)
    return state.select(F.col("key.key").alias("key"), F.col("value.sum").alias("n"))


def changed_totals(spark: SparkSession, checkpoint: str, before: int, after: int) -> DataFrame:
    """``(key, n_before, n_after)`` of the keys whose value differs between two micro-batches.

    This reads the state's changes from ``before + 1`` to ``after`` and neither
    of the states, so it costs what has changed. A key that was not known has a
    NULL before; a key that was only seen again with its old value is left out.
    """
    feed = spark.read.format("statestore").option("readChangeFeed", True)
    changes = feed.option("changeStartBatchId", before + 1).option("changeEndBatchId", after).load(checkpoint)
    each = changes.select(
        F.col("key.key").alias("key"),
        F.col("value.sum").alias("total"),
        (F.col("value.sum") - F.col("value.max.brought")).alias("base"),
        (F.col("value.min") == F.col("value.max.at")).alias("is_new"),
        "batch_id",
    )
    first = F.min_by(F.struct("base", "is_new"), "batch_id").alias("first")
    ends = each.groupBy("key").agg(first, F.max_by("total", "batch_id").alias("n_after"))
    old = F.when(~F.col("first.is_new"), F.col("first.base"))
    return ends.select("key", old.alias("n_before"), "n_after").filter(~F.col("n_before").eqNullSafe(F.col("n_after")))
