"""Snapshots of a running or ended query, read from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.streaming.counts import STATE


def read_snapshot(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``(key, n)`` as of a finished micro-batch, the last one by default.

    Reading does not stop or change the query that owns the checkpoint.
    """
    reader = spark.read.format("statestore").option("stateVarName", STATE)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint).select(F.col("key.key").alias("key"), F.col("value.n").alias("n"))


def snapshot_metadata(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a checkpoint by operator, store and variable, with its batches.

    How many partitions it has depends on the cluster and is left out.
    """
    stores = spark.read.format("state-metadata").load(checkpoint)
    named = F.get_json_object("operatorProperties", "$.stateVariables")
    variables = F.from_json(named, "array<struct<stateName: string>>")
    return stores.select(
        F.col("operatorName").alias("operator"),
        F.col("stateStoreName").alias("store"),
        F.array_join(F.transform(variables, lambda v: v["stateName"]), ",").alias("variables"),
        F.col("minBatchId").alias("first_batch"),
        F.col("maxBatchId").alias("last_batch"),
    ).distinct()
