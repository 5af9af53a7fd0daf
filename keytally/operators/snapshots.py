"""State snapshots as tables ``(key, n)``: take, edit, list, compare, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from keytally.functions.binary import literal_bytes
from keytally.functions.doubles import double_bytes
from keytally.operators.counting import final_count

LAST_N = 5
# Fixed value: 0.0 as eight bytes.
ZERO_DOUBLE = bytes(8)
BROADCAST_KEYS = 10_000


def snapshot_at(rows: DataFrame, cut: Column | int, key: str = "key", seq: str = "seq") -> DataFrame:
    """The state after all rows up to ``cut``: a consistent prefix of the stream."""
    limit = cut if isinstance(cut, Column) else F.lit(cut)
    return final_count(rows.filter(F.col(seq) <= limit), key)


def in_key_order(snapshot: DataFrame, key: str = "key") -> DataFrame:
    """All entries by key; Spark orders strings by their UTF-8 bytes."""
    return snapshot.orderBy(key)


def tail(snapshot: DataFrame, n: int = LAST_N, key: str = "key") -> DataFrame:
    """The last ``n`` entries in key order, by a bounded heap per task."""
    return snapshot.orderBy(F.col(key).desc()).limit(n)


def last_record(snapshot: DataFrame, key: str = "key") -> DataFrame:
    return tail(snapshot, 1, key)


def _edit_tail(snapshot: DataFrame, n: int, key: str, column: str, value: Column) -> DataFrame:
    # The mark is made from the value, so both sides need the same columns of the
    # snapshot and share its shuffle where it is not a stored table yet.
    mark = F.hash(column)
    # A key that a snapshot repeats is one hit, or the join would repeat its rows.
    chosen = tail(snapshot, n, key).groupBy(F.col(key).alias("_hit")).agg(F.first(mark).alias("_mark"))
    if n <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)
    joined = snapshot.join(chosen, F.col(key).eqNullSafe(F.col("_hit")), "left")
    new = F.when(F.col("_mark").isNotNull(), value).otherwise(F.col(column))
    return joined.withColumn(column, new.cast(snapshot.schema[column].dataType)).select(
        *snapshot.columns
    )


def edit_last_n(
    snapshot: DataFrame, n: int = LAST_N, value: float | bytes = 0, key: str = "key", column: str = "n"
) -> DataFrame:
    """Set the values of the last ``n`` entries; with fewer entries, of all of them.

    A snapshot holds a key once; of a key that is repeated all entries are set.
    The hits are broadcast if ``n`` is at most ``BROADCAST_KEYS`` and shuffled
    otherwise, with the same result.

    A snapshot of raw values takes bytes, such as ``ZERO_DOUBLE``, or a number,
    which is stored as the eight bytes of a double.
    """
    if isinstance(value, bytes):
        new = literal_bytes(value)
    elif snapshot.schema[column].dataType == BinaryType():
        new = double_bytes(F.lit(float(value)))
    else:
        new = F.lit(value)
    return _edit_tail(snapshot, n, key, column, new)


def suffix_last(
    snapshot: DataFrame, suffix: str = "_modified", key: str = "key", column: str = "value"
) -> DataFrame:
    """Append ``suffix`` to the text value of the last key."""
    return _edit_tail(snapshot, 1, key, column, F.concat(F.col(column), F.lit(suffix)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "key", column: str = "n") -> DataFrame:
    """Keys whose value differs, as ``(key, n_before, n_after)``.

    Both sides hold a key once, so grouping their union pairs them without a
    join and keeps a NULL key; a missing side shows as NULL.
    """
    none = F.lit(None).cast(before.schema[column].dataType)
    left = before.select(key, F.col(column).alias("b"), none.alias("a"), F.lit(1).alias("in_b"), F.lit(0).alias("in_a"))
    right = after.select(key, none.alias("b"), F.col(column).alias("a"), F.lit(0).alias("in_b"), F.lit(1).alias("in_a"))
    paired = left.unionByName(right).groupBy(key).agg(
        F.max("b").alias(f"{column}_before"),
        F.max("a").alias(f"{column}_after"),
        F.max("in_b").alias("in_b"),
        F.max("in_a").alias("in_a"),
    )
    same = F.col(f"{column}_before").eqNullSafe(F.col(f"{column}_after")) & (F.col("in_b") == F.col("in_a"))
    return paired.filter(~same).select(key, f"{column}_before", f"{column}_after")


def edit_report(snapshot: DataFrame, n: int = LAST_N) -> DataFrame:
    """How many entries there are and how many an edit of the last ``n`` sets."""
    return snapshot.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.least(F.col("total"), F.lit(n).cast("bigint")).alias("replaced")
    )
