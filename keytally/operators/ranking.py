"""Largest entry per group, lowest name first on ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest(rows: DataFrame, group: str, name: str, size: str) -> DataFrame:
    """``(group, name, size)`` of the largest entry of each group.

    The first aggregation keeps one name per ``(group, size)``, which leaves
    ``max_by`` nothing to tie on. Both combine before they shuffle, and with a
    numeric name both are hash aggregations, which ``max`` of a struct is not.
    """
    first_of_size = rows.groupBy(group, size).agg(F.min(name).alias(name))
    return first_of_size.groupBy(group).agg(
        F.max_by(name, size).alias(name), F.max(size).alias(size)
    )


def largest_state_file(files: DataFrame, excluded: str = "_metadata") -> DataFrame:
    """The largest file of each folder but ``excluded``, from ``(path, length)``.

    Empty files never win: the search starts from size 0 and asks for more.
    """
    named = files.select("path", "length").filter(F.col("length") > 0)
    base = F.regexp_extract("path", "[^/]*$", 0)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return largest(named.filter(base != excluded).withColumn("folder", folder), "folder", "path", "length")
