"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks, and one block is due per slot. With
weights that are integers out of their sum Q, block k of a source of weight w may
not come before slot floor(k * Q / w), its release, and has to come before slot
ceil((k + 1) * Q / w), its deadline. Taking the released block of the earliest
deadline in each slot meets all of them, so that in every prefix each source is
less than one block away from its target.

The schedule repeats after Q slots. One period, or the part of it that is used, is
worked out from the weights alone; the slot of any block then follows by
arithmetic, in parallel. When a source has no blocks left, the others go on at
their weights' proportions in a new period; no document is dropped or repeated.

Every source has a weight of its own. The driver holds one entry per source and at
most one per block of a period that is used; blocks and documents stay in tables.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytally.llm.tables import named_again, numbered, row_hash, small, stored

BLOCK_ROWS = 16
#: Rows that one task numbers together, on average.
CELL_ROWS = 4_000
#: Blocks whose slots one row of the schedule gives.
RUN_BLOCKS = 1 << 14
OTHER = None


def one_period(weights: list[int], left: list[int]) -> tuple[list[list[int]], int | None]:
    """For each source, the slots of its blocks in one period of ``sum(weights)`` slots.

    It ends in the slot, which comes second, that is due to a source with no more of
    its ``left`` blocks, if there is such a slot in the period.
    """
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    coming: list[tuple[int, int]] = []
    ready = [(-(-total // weight), source) for source, weight in enumerate(weights)]
    heapq.heapify(ready)
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, source = heapq.heappop(coming)
            due = -(-(len(slots[source]) + 1) * total // weights[source])
            heapq.heappush(ready, (due, source))
        _, source = heapq.heappop(ready)
        if len(slots[source]) == left[source]:
            return slots, slot
        slots[source].append(slot)
        if len(slots[source]) < weights[source]:
            heapq.heappush(coming, (len(slots[source]) * total // weights[source], source))
    return slots, None


def periods(blocks: list[int], weights: list[int]) -> list[list[dict]]:
    """For each source, its stretches: from which block on, how many, and the slots of those blocks.

    A stretch ends in the slot that would need a block some source lacks; sources
    without a block in a stretch have no entry for it.
    """
    found: list[list[dict]] = [[] for _ in blocks]
    used, base = [0] * len(blocks), 0
    running = [s for s in range(len(blocks)) if blocks[s]]
    while running:
        shared = gcd(*[weights[s] for s in running])
        parts = [weights[s] // shared for s in running]
        left = [blocks[s] - used[s] for s in running]
        total = sum(parts)
        slots, end = one_period(parts, left)
        if end is None:
            end = min(n // part * total + slots[i][n % part] for i, (n, part) in enumerate(zip(left, parts)))
        whole, rest = divmod(end, total)
        for i, (s, part) in enumerate(zip(running, parts)):
            n = whole * part + bisect_left(slots[i], rest)
            if n:
                found[s].append({"from_block": used[s], "n": n, "base": base, "total": total, "slots": slots[i]})
            used[s] += n
        base += end
        running = [s for s in running if used[s] < blocks[s]]
    return found


def schedule(spark: SparkSession, blocks: list[int], weights: list[int]) -> DataFrame:
    """``(pool, block, slot)`` of every block of every source, stored."""
    rows = (
        (pool, s["from_block"], s["n"], s["base"], s["total"], s["slots"])
        for pool, stretches in enumerate(periods(blocks, weights))
        for s in stretches
    )
    schema = "pool int, from_block bigint, n bigint, base bigint, total bigint, slots array<bigint>"
    # One table per so many rows, so that the driver never holds them twice.
    parts = [stored(spark.createDataFrame(part, schema), "stretches") for part in _parts(rows, 1 << 16)]
    table = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    runs = table.withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {RUN_BLOCKS}L)")))
    runs = runs.repartition("pool", "from_block", "first")
    each = runs.withColumn("k", F.explode(F.expr(f"sequence(first, least(first + {RUN_BLOCKS}, n) - 1)")))
    slot = F.expr("base + k div size(slots) * total + slots[cast(k % size(slots) as int)]")
    return stored(each.select("pool", (F.col("from_block") + F.col("k")).alias("block"), slot.alias("slot")), "schedule")


def _parts(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while part := list(islice(rows, size)):
        yield part


def target_weights(docs: DataFrame, source: str = "source", power: float = 0.5, parts: int = 1_000) -> dict:
    """Integer weights of all sources by the counts' ``power``, adding up to about ``parts``.

    With more than a quarter as many sources they add up to four for each, so that small
    ones differ too. Rows without a source have the weight of the key ``OTHER``.
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("s")).count()
    sizes = {OTHER: 0} | {row["s"]: row["count"] for row in counts.toLocalIterator()}
    scale = sum(n**power for n in sizes.values()) or 1.0
    parts = max(parts, 4 * len(sizes))
    return {s: max(1, round(parts * n**power / scale)) for s, n in sorted(sizes.items(), key=lambda x: (x[0] is not OTHER, x[0] or ""))}


def mix(
    docs: DataFrame,
    weights: dict,
    id: str = "doc_id",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    seed: int = 42,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_pool``, ``mix_block``, ``mix_slot`` and ``mix_at``.

    Ordered by ``(mix_slot, mix_at)``, every prefix of whole slots keeps each
    pool within one block of its weight as long as no pool has run out, and
    within one block of the remaining pools' weights in each stretch after that.
    ``weights`` are positive integers by source; sources without a weight, NULL
    included, share the pool and weight of the key ``None`` (1 by default). A
    pool's documents are shuffled by a hash of their columns and numbered in cells, so
    no task has to take a whole source; only rows that repeat in every column are
    numbered next to each other. Input columns of those four names are replaced. An
    empty table gives an empty result.
    """
    if not all(isinstance(w, int) and w > 0 for w in weights.values()):
        raise ValueError("weights are positive integers")
    spark = docs.sparkSession
    names = [s for s in weights if s is not OTHER]
    pools = stored(spark.createDataFrame([*zip(names, range(len(names)))], "_name string, _pool int"), "pools")
    plain = numbered(docs)
    hashed = row_hash(plain, seed)
    id, source = (f"_{docs.columns.index(c)}" for c in (id, source))
    plain = plain.withColumn("_h", hashed).join(small(pools), F.col(source).cast("string") == F.col("_name"), "left")
    plain = plain.withColumn("_pool", F.coalesce("_pool", F.lit(len(names))))

    counts = {row["_pool"]: row["count"] for row in plain.groupBy("_pool").count().toLocalIterator()}
    sizes = [counts.get(i, 0) for i in range(len(names) + 1)]
    slots = schedule(spark, [-(-n // block_rows) for n in sizes], [*(weights[s] for s in names), weights.get(OTHER, 1)])
    cells = [max(1, -(-n // cell_rows)) for n in sizes]
    table = [*zip(range(len(sizes)), cells, [*names, OTHER])]
    table = stored(spark.createDataFrame(table, "_pool int, _cells bigint, _mix_pool string"), "cells")

    celled = plain.join(small(table), "_pool")
    celled = celled.withColumn("_cell", F.shiftright(F.pmod("_h", F.lit(1 << 31)) * F.col("_cells"), 31))
    before = Window.partitionBy("_pool").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("_pool", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = stored(starts.select("_pool", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "cells")
    place = F.row_number().over(Window.partitionBy("_pool", "_cell").orderBy("_h", id))
    ranked = celled.withColumn("_place", place - 1).join(small(starts), ["_pool", "_cell"])
    rank = F.col("_start") + F.col("_place")
    ranked = ranked.withColumns({"_block": F.expr(f"(_start + _place) div {block_rows}"), "_at": rank % block_rows})
    slots = slots.select(F.col("pool").alias("_pool"), F.col("block").alias("_block"), F.col("slot").alias("_slot"))
    slotted = ranked.join(small(slots), ["_pool", "_block"])
    own = {"mix_pool": F.col("_mix_pool"), "mix_block": F.col("_block"), "mix_slot": F.col("_slot"), "mix_at": F.col("_at")}
    kept = [c for c, name in zip(named_again(slotted, docs), docs.columns) if name not in own]
    return slotted.select(*kept, *[c.alias(name) for name, c in own.items()])
