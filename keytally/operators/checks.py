"""Invariants of counts and snapshots, as rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_runs(counted: DataFrame, key: str = "key", initial: DataFrame | None = None) -> DataFrame:
    """Keys whose emitted counts are not exactly base+1 .. base+c, each once.

    Sums tell: c distinct values between base+1 and base+c are all of them,
    and a value seen twice shows in the per-value count.
    """
    values = counted.groupBy(key, "n").agg(F.count(F.lit(1)).alias("times"))
    runs = values.groupBy(key).agg(
        F.sum("times").alias("c"), F.max("times").alias("repeats"),
        F.min("n").alias("low"), F.max("n").alias("high"),
    )
    base = F.lit(0).cast("bigint")
    if initial is not None:
        state = initial.select(F.col(key).alias("_k"), F.col("n").alias("_base"))
        runs = runs.join(state, F.col(key).eqNullSafe(F.col("_k")), "left")
        base = F.coalesce("_base", F.lit(0).cast("bigint"))
    good = (F.col("repeats") == 1) & (F.col("low") == base + 1) & (F.col("high") == base + F.col("c"))
    return runs.filter(~good).select(key, "c", "low", "high")


def repeated_keys(snapshot: DataFrame, key: str = "key") -> DataFrame:
    """Keys a snapshot holds more than once."""
    return snapshot.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
