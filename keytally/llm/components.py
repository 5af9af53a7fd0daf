"""Connected components by contraction; no task and no driver ever holds a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the component's smallest node.

    In each round every node hooks onto the neighbour, or itself, that ranks
    first, and edges are redrawn between the nodes hooked onto. Odd rounds rank
    by id, which settles stars around their smallest node at once; even rounds
    by a hash, which makes long chains shrink by a constant factor. A node with
    many links costs a combined minimum, and rows that a skewed join may split.
    """
    edges = stored(links.filter("a <> b").select("a", "b").distinct(), "edges")
    placed = None
    round_ = 0
    while not edges.isEmpty():
        round_ += 1

        def rank(c: str) -> Column:
            order = F.lit(0).cast("bigint") if round_ % 2 else F.xxhash64(F.col(c), F.lit(round_))
            return F.struct(order.alias("h"), F.col(c).alias("id"))

        both = edges.select("a", rank("b").alias("r")).unionByName(edges.select(F.col("b").alias("a"), rank("a").alias("r")))
        first = both.groupBy("a").agg(F.min("r").alias("r"))
        hooked = stored(first.select("a", F.least("r", rank("a"))["id"].alias("p")), "hooked")
        ends = edges.join(hooked, "a").select(F.col("p").alias("pa"), "b")
        ends = ends.join(hooked.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb")
        low, high = F.least("pa", "pb"), F.greatest("pa", "pb")
        edges = stored(ends.select(low.alias("a"), high.alias("b")).distinct(), "edges")
        if placed is None:
            placed = hooked.select(F.col("a").alias("node"), F.col("p").alias("at"))
        else:
            moved = placed.join(hooked.select(F.col("a").alias("at"), "p"), "at", "left")
            placed = stored(moved.select("node", F.coalesce("p", "at").alias("at")), "placed")
    if placed is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = placed.groupBy("at").agg(F.min("node").alias("root"))
    return stored(placed.join(roots, "at").select("node", "root"), "components")
