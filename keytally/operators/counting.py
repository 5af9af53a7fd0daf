"""Per-key running and final counts over a batch.

A key may hold a third of all rows, so no step gives one task all rows of such
a key: counts are combined before the shuffle, and a long key is numbered in
stretches of the arrival order, one for each range partition that it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytally.session import stored

#: A key of more rows is numbered in stretches; rows of a stretch, about.
STRETCH_ROWS = 1 << 20
#: Rows of long keys that go to one range, about: small beside a task's rows, so that tasks get like shares.
RANGE_STRETCH_ROWS = 1 << 18
#: Rows that a task sorts and numbers, about, besides a few keys or stretches more that fall to it by hash.
TASK_ROWS = 1 << 21
#: Long keys that are broadcast; more of them are joined by a shuffle, with the same result.
BROADCAST_KEYS = 100_000
#: Rows that a counted range is spread in, and made in.
SPREAD_ROWS = 1_000_000
RANGE_ROWS = 10_000


def final_count(rows: DataFrame, key: str = "key", weight: str | None = None) -> DataFrame:
    """``(key, n)``: what the state holds after the last row."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(key).agg(counted.alias("n"))


def merge_state(*states: DataFrame, key: str = "key") -> DataFrame:
    """Add up ``(key, n)`` states; keys found in only one of them stay."""
    merged = states[0].select(key, "n")
    for state in states[1:]:
        merged = merged.unionByName(state.select(key, "n"))
    return final_count(merged, key, weight="n")


def _lifted(rows: DataFrame, size: int, lifts: DataFrame | None, place: list[str], order: list[str]) -> DataFrame:
    """The ``size`` ``rows`` and ``n``, their place in their group plus the group's ``_base``.

    A base is one more row of its group that comes first and weighs what it
    holds, so it goes along with the shuffle of the rows and nothing is joined.
    Many rows are dealt out over more tasks than the session shuffles to, so
    that what a task sorts does not grow with the input.
    """
    weighed = rows.withColumns({"_is_row": F.lit(1), "_weight": F.lit(1).cast("bigint")})
    if lifts is not None:
        bases = lifts.select(*place, F.lit(0).alias("_is_row"), F.col("_base").alias("_weight"))
        weighed = weighed.unionByName(bases, allowMissingColumns=True)
    if size > TASK_ROWS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        weighed = weighed.repartition(-(-size // TASK_ROWS), *place)
    upto = Window.partitionBy(*place).orderBy("_is_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    return weighed.withColumn("n", F.sum("_weight").over(upto)).filter("_is_row = 1").drop("_is_row", "_weight")


def long_keys(rows: DataFrame, key: str, stretch_rows: int) -> tuple[DataFrame, int, int, int]:
    """A stored table ``(_long)`` of the keys with more than ``stretch_rows`` rows, their number and rows, and the other keys' rows.

    There are at most (all rows) / ``stretch_rows`` of them.
    """
    is_long = F.col("n") > stretch_rows
    marked = final_count(rows, key).select(is_long.alias("_is_long"), F.when(is_long, F.col(key)).alias("_long"), "n")
    # One row for each long key, and one for all others together.
    found = stored(marked.groupBy("_is_long", "_long").agg(F.sum("n").alias("n")), "long-keys")
    of_long, of_rest = F.sum(F.when(F.col("_is_long"), F.col("n"))), F.sum(F.when(~F.col("_is_long"), F.col("n")))
    number, size, rest = found.agg(F.count_if("_is_long"), F.coalesce(of_long, F.lit(0)), F.coalesce(of_rest, F.lit(0))).first()
    return found.filter("_is_long").select("_long"), number, size, rest


def running_count(
    rows: DataFrame,
    key: str = "key",
    seq: str | list[str] = "seq",
    initial: DataFrame | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """The columns of ``rows`` and ``n``: how often the key has been seen up to and
    with this row, on top of its ``initial`` state ``(key, n)`` if there is one.

    ``seq`` names the arrival order, unique within a key, of any type that can
    be ordered; NULL comes first. The key is of any type that can be grouped.

    Keys of at most ``stretch_rows`` rows are numbered by one shuffle on the key.
    Rows of longer keys are range-partitioned by key and arrival and stored; a
    partition holds one stretch of each of its keys, and is numbered per key and
    stretch, lifted by a prefix sum over the stretches' counts. No row is held
    against a list of cuts, so a row costs the same whatever the number of
    stretches, and nothing is broadcast but a counted list of long keys. The
    counts by key are taken, and the long keys' rows stored, when this is
    called; the rest runs when the result is asked for. ``rows`` are read for
    each of these, so they have to be the same each time.
    """
    order = [seq] if isinstance(seq, str) else list(seq)
    state = None
    if initial is not None:
        state = initial.select(F.col(key).cast(rows.schema[key].dataType).alias(key), F.col("n").cast("bigint").alias("_base"))
    keys, number, size, others = long_keys(rows, key, stretch_rows)
    if not number:
        return _lifted(rows, others, state, [key], order)
    keys = F.broadcast(keys) if number <= BROADCAST_KEYS else keys
    is_long = F.col(key).eqNullSafe(F.col("_long"))
    rest, held = rows.join(keys, is_long, "left_anti"), None
    if state is not None:
        state, held = state.join(keys, is_long, "left_anti"), state.join(keys, is_long, "left_semi")
    short = _lifted(rest, others, state, [key], order)
    return short.unionByName(_count_long(rows.join(keys, is_long, "left_semi"), size, key, order, held))


def in_stretches(rows: DataFrame, size: int, key: str, order: list[str]) -> DataFrame:
    """``size`` rows stored by ranges of key and arrival, with the number of their range, ``_stretch``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(max(parts, -(-size // RANGE_STRETCH_ROWS)), key, *order)
    # The bounds are sampled anew each time, so the stretches hold only once they are stored.
    return stored(dealt.withColumn("_stretch", F.spark_partition_id()), "stretches")


def _count_long(rows: DataFrame, size: int, key: str, order: list[str], state: DataFrame | None) -> DataFrame:
    placed = in_stretches(rows, size, key, order)
    sums = placed.groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("_c"))
    if state is not None:
        sums = sums.unionByName(state.select(key, F.lit(-1).alias("_stretch"), F.col("_base").alias("_c")))
    # A key has a row here for each stretch, so never more than there are partitions.
    earlier = Window.partitionBy(key).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    lifts = sums.withColumn("_base", F.sum("_c").over(earlier)).filter("_stretch >= 0 and _base > 0")
    return _lifted(placed, size, lifts, [key, "_stretch"], order).drop("_stretch")


def running_count_by_window(rows: DataFrame, key: str = "key", seq: str | list[str] = "seq") -> DataFrame:
    """The same by one window per key; only for keys known to be small."""
    order = [seq] if isinstance(seq, str) else list(seq)
    numbered = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("n", numbered.cast("bigint"))


def expand_ranges(ranges: DataFrame, key: str = "key", piece: int = RANGE_ROWS, partitions: int | None = None) -> DataFrame:
    """``(key, base, cnt)`` to the rows ``(key, base+1) .. (key, base+cnt)``.

    Ranges are cut into pieces of ``SPREAD_ROWS`` that are dealt out over
    ``partitions`` tasks (the session's number of shuffle partitions if not
    given; it has to be given, or the small input would have tasks merged before
    it grows), and made in pieces of ``piece`` rows.
    """
    spread_rows = max(SPREAD_ROWS, piece)
    number = partitions or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(rows: DataFrame, size: int) -> DataFrame:
        firsts = F.explode(F.sequence("first", "last", F.lit(size).cast("bigint")))
        pieces = rows.select(key, "last", firsts.alias("first"))
        return pieces.select(key, "first", F.least("last", F.col("first") + (size - 1)).alias("last"))

    some = ranges.filter("cnt > 0")
    whole = some.select(key, (F.col("base") + 1).alias("first"), (F.col("base") + F.col("cnt")).alias("last"))
    dealt = cut(whole, spread_rows).repartition(number, key, "first")
    return cut(dealt, piece).select(key, F.explode(F.sequence("first", "last")).alias("n"))


def emitted_counts(rows: DataFrame, key: str = "key", initial: DataFrame | None = None) -> DataFrame:
    """All emitted ``(key, n)`` without the rows they belong to.

    A key with c rows emits 1..c in whatever order its rows come, so only the
    combined counts are shuffled, never the rows.
    """
    counts = final_count(rows, key).withColumnRenamed("n", "cnt")
    if initial is None:
        return expand_ranges(counts.withColumn("base", F.lit(0).cast("bigint")), key)
    both = counts.select(key, "cnt", F.lit(0).cast("bigint").alias("base")).unionByName(
        initial.select(key, F.lit(0).cast("bigint").alias("cnt"), F.col("n").alias("base"))
    )
    summed = both.groupBy(key).agg(F.sum("cnt").alias("cnt"), F.sum("base").alias("base"))
    return expand_ranges(summed, key)


def typed_pairs(counted: DataFrame, key: str = "key") -> DataFrame:
    """Exactly ``(key STRING, n INT)``; a count beyond 32 bits raises in ANSI mode."""
    return counted.select(F.col(key).cast("string").alias(key), F.col("n").cast("int").alias("n"))
