"""The given tables seen as keyed streams, words, and binary contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.session import SCAN_PARTITIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, read with its declared schema.

    A file stream takes a directory or a glob, and a table may be either one
    file or a directory of files, so the last letter is written as a glob.
    """
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


def widen(rows: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over as many tasks as the session asks for.

    A file with one row group is one task, however much text is in it. Without
    the setting ``spark.keytally.scan.partitions`` the scan stays as it is.
    """
    wanted = rows.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(wanted)) if wanted and not rows.isStreaming else rows


def keyed_events(events: DataFrame) -> DataFrame:
    """``events`` as ``(seq, key)``: arrival number and counting key."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.col("event_type"), F.lit(":"), (F.col("user_id") % 50).cast("string")).alias("key"),
    )


def document_words(documents: DataFrame) -> DataFrame:
    """``documents`` as ``(doc_id, pos, key)``: one row per blank-separated word."""
    texts = widen(documents.select("doc_id", "text"))
    return texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "key"))


def page_bytes(pages: DataFrame) -> DataFrame:
    """``pages`` as ``(page_id, content)`` with the page's UTF-8 bytes."""
    texts = widen(pages.select("page_id", "html"))
    return texts.select("page_id", F.encode("html", "UTF-8").alias("content"))
