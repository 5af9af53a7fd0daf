"""Per-key running counts over a stream, with state that can be restarted,
read as a snapshot, and started from one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from keytally.operators.counting import expand_ranges

STATE = "count"
AVAILABLE_NOW = {"availableNow": True}
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Each batch uploads its changes, not a copy of the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # The number of keys is a metric that costs one more look-up for each write.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


class CountProcessor(StatefulProcessor):
    """One value state per key; each input row carries how many records it stands for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState(STATE, "n bigint")

    def _current(self) -> int:
        held = self.count.get()
        return 0 if held is None else held[0]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.count.update((self._current() + initialState.n,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        base = self._current()
        for row in rows:
            yield Row(key=key[0], base=base, cnt=row.cnt)
            base += row.cnt
        self.count.update((base,))

    def close(self) -> None:
        pass


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by("key").aggregate([([], "count_all")])
        yield from counted.rename_columns(["key", "cnt"]).to_batches()


def stream_counts(
    rows: DataFrame, initial: DataFrame | None = None, key: str = "key", partitions: int | None = None
) -> DataFrame:
    """``(key, n)`` for every record of the stream ``rows``.

    Records are combined per key inside each task before the shuffle, so a key
    with a third of all records sends one row per Arrow batch. The state gives
    each such row its range of counts, and the ranges are expanded after a
    second, equally small, shuffle that spreads them. ``initial`` is a batch
    ``(key, n)``; it is used in the first micro-batch of a new checkpoint only.
    ``partitions`` is the number that ``start`` is given.
    """
    combined = rows.select(F.col(key).cast("string").alias("key")).mapInArrow(
        _combine, "key string, cnt bigint"
    )
    state = None
    if initial is not None:
        state = initial.select(F.col(key).cast("string").alias("key"), F.col("n").cast("bigint"))
        state = state.groupBy("key")
    ranges = combined.groupBy("key").transformWithState(
        CountProcessor(), "key string, base bigint, cnt bigint", "Append", "None", initialState=state
    )
    return expand_ranges(ranges, partitions=partitions).withColumnRenamed("key", key)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """The session's settings while a query with state is started."""
    settings = dict(STATE_CONF)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    old = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start(
    counted: DataFrame, output: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Start writing ``counted`` as parquet, with state in ``checkpoint``.

    The file sink commits each micro-batch once. ``trigger`` is passed on;
    by default all that has arrived is processed and the query ends. A new
    checkpoint keeps ``partitions``, the session's number of shuffle partitions
    if not given, for good.
    """
    with state_settings(counted.sparkSession, partitions):
        return (
            counted.writeStream.format("parquet")
            .outputMode("append")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW))
            .start()
        )


def run(counted: DataFrame, output: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Process all that has arrived and return everything written so far.

    The same checkpoint continues where the last run ended; that is a restart.
    """
    start(counted, output, checkpoint, partitions=partitions).awaitTermination()
    return counted.sparkSession.read.schema(counted.schema).parquet(output)


def resume_from_snapshot(
    rows: DataFrame, snapshot: DataFrame, output: str, checkpoint: str, partitions: int | None = None
) -> DataFrame:
    """Count a new stream from a snapshot; the checkpoint must be a new one."""
    if path_exists(rows.sparkSession, checkpoint):
        raise ValueError(f"{checkpoint} is in use: a snapshot only starts a new checkpoint")
    return run(stream_counts(rows, initial=snapshot, partitions=partitions), output, checkpoint, partitions)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
