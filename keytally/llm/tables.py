"""Small helpers the operators share: stored tables and joins on checked sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from keytally.session import work_dir

#: Rows of ids (at most 40 bytes each) that one broadcast may hold.
BROADCAST_ROWS = 1_000_000


def stored(rows: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``rows`` written to the shared folder and read back, so that nothing above is run again.

    ``batch_rows`` bounds the rows handed to Python at a time, for functions
    that need many times the size of their input.
    """
    spark = rows.sparkSession
    path = work_dir(spark, label)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if batch_rows:
        spark.conf.set(setting, batch_rows)
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(rows.schema).parquet(path)


def small(ids: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of ids, given only if it has few rows.

    Beyond ``BROADCAST_ROWS`` the join shuffles; the result is the same.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 modulo 4. False for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text as it is; NULL for NULL. With the id it tells rows apart that share an id."""
    return F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named ``_0``, ``_1`` and so on, so that no added name can clash."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def named_again(rows: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of ``numbered(docs)`` in ``rows``, under their own names."""
    return [rows[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)]


def _has_map(kind: DataType) -> bool:
    return any(name in kind.simpleString() for name in ("map<", "variant"))


def row_hash(rows: DataFrame, seed: int = 42) -> Column:
    """Of all columns that Spark can hash, so that rows which share an id or have none are told apart."""
    return F.xxhash64(*[f.name for f in rows.schema.fields if not _has_map(f.dataType)], F.lit(seed))


def one_of_repeated(rows: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """``rows`` with one row of each that the stored table ``repeated`` has by ``keys``; all others stay.

    The row of the smallest ``row_hash`` stays. Rows are combined before the shuffle, so a key may
    have any number of them. Keys may be NULL.
    """
    if repeated.isEmpty():
        return rows
    named = repeated.select(*[F.col(k).alias(f"_repeated_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_repeated_{k}"))
    several = rows.join(small(named), same, "left_semi")
    one = F.min_by(F.struct(*rows.columns), row_hash(rows)).alias("_row")
    once = several.groupBy(*keys).agg(one).select("_row.*")
    return rows.join(small(named), same, "left_anti").unionByName(once)
