"""Exact duplicates, with the heavy hitters split off.

Texts are equal if they are identical after each run of blanks (space and the
control characters 9 to 13) becomes one space. Misra-Gries summaries, one per
task, find the digests that may hold a large share of the rows; those that an
exact count confirms are broadcast and their rows are settled without a shuffle.
All other digests are counted by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import named_again, numbered, one_of_repeated, small, stored, text_or_empty

#: A digest is frequent if it holds at least this share of the rows.
SHARE = 1 / 500
#: Counters of each task's summary. It loses at most rows / (COUNTERS + 1) of a
#: count, so at most 1 / (SHARE - 1 / (COUNTERS + 1)) = 977 digests can qualify.
COUNTERS = 1023
# A run of blanks other than a single space, which may stay as it is.
_RUNS = r" [ \t-\r]+|[\t-\r][ \t-\r]*"


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), _RUNS, " ").cast("binary"), 256))


def misra_gries(values: Iterator[pa.Array], counters: int) -> dict[bytes, int]:
    """At most ``counters`` values with lower bounds of their counts."""
    kept: dict[bytes, int] = {}
    for array in values:
        for pair in pc.value_counts(array):
            value = pair["values"].as_py()
            kept[value] = kept.get(value, 0) + pair["counts"].as_py()
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {value: n - cut for value, n in kept.items() if n > cut}
    return kept


def frequent(digests: DataFrame, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """``(digest, keep_id, group_size)`` of each digest with at least ``share`` of the rows.

    ``digests`` is a stored table ``(doc_id, digest)``. The number of rows is
    bounded by the parameters, whatever the table holds.
    """
    schema = "digest binary, low bigint"

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = misra_gries((batch.column(0) for batch in batches), counters)
        yield pa.record_batch([pa.array(kept, pa.binary()), pa.array(kept.values(), pa.int64())], ["digest", "low"])

    least = digests.count() * share
    lost = least / share / (counters + 1)
    possible = digests.select("digest").mapInArrow(summary, schema).groupBy("digest").agg(F.sum("low").alias("low"))
    possible = stored(possible.filter(F.col("low") >= least - lost).select("digest"), "frequent")
    exact = digests.join(F.broadcast(possible), "digest").groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return stored(exact.filter((F.col("group_size") >= least) & (F.col("group_size") > 1)), "winners")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)``, one row per row of ``docs``.

    The smallest id of equal texts stays. Rows without an id stay only if no
    equal text has one, and then have no ``keep_id``. Rows that repeat an id and
    text are one document: they stay or go together. An empty table gives an
    empty result; other columns are not read.
    """
    digests = stored(docs.select(F.col(id).alias("doc_id"), digest_of(text).alias("digest")), "digests")
    winners = frequent(digests)
    seen = digests.join(F.broadcast(winners), "digest", "left")
    settled = seen.filter(F.col("group_size").isNotNull())
    rest = seen.filter(F.col("group_size").isNull()).select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = rest.join(groups.filter("group_size > 1"), "digest", "left")
    single = F.col("group_size").isNull()
    shuffled = grouped.select(
        "doc_id",
        "digest",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
    )
    both = settled.select(shuffled.columns).unionByName(shuffled)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Of rows that repeat the id and text that stay, one stays, by a hash of its columns.
    """
    groups = exact_groups(docs, id, text)
    gone = stored(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "digest").distinct(), "copies")
    gone = gone.withColumnRenamed("digest", "_digest")
    place = f"_{docs.columns.index(id)}"
    marked = numbered(docs).withColumn("_is", digest_of(f"_{docs.columns.index(text)}"))
    same = F.col(place).eqNullSafe(F.col("_gone")) & (F.col("_is") == F.col("_digest"))
    repeated = groups.filter("kept and group_size > 1").groupBy(F.col("doc_id").alias(place), F.col("digest").alias("_is"))
    repeated = stored(repeated.count().filter("count > 1"), "repeated")
    left = one_of_repeated(marked.join(small(gone), same, "left_anti"), [place, "_is"], repeated)
    return left.select(*named_again(left, docs))
