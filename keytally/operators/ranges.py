"""Search, dump and check files by byte ranges; results are those of whole contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytally.functions.binary import find_bytes, literal_bytes, read_u32
from keytally.functions.checksum import ONES, crc32c_part_udf, crc32c_start_udf
from keytally.operators.binary import ROW, encodings_of, hex_dump, match_context
from keytally.sources.ranges import RANGE_BYTES, file_ranges, read_windows

FOOTER = 8


def _first(offset: Column) -> Column:
    """The first place in the file of what ranges found at ``offset`` or not (-1)."""
    return F.coalesce(F.min(F.when(offset >= 0, F.col("start") + offset)), F.lit(-1).cast("bigint"))


def search_files(spark: SparkSession, root: str, pattern: bytes, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, offset)``: each file's first match of ``pattern``, -1 if there is none."""
    ranges = file_ranges(spark, root, glob, size, overlap=max(len(pattern) - 1, 0))
    return ranges.groupBy("path").agg(_first(find_bytes(F.col("content"), pattern)).alias("offset"))


def search_files_encodings(spark: SparkSession, root: str, target: bytes, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, label, offset)`` for each form of ``target`` that a file holds."""
    forms = encodings_of(target)
    ranges = file_ranges(spark, root, glob, size, overlap=max(len(target) - 1, 0))
    firsts = ranges.groupBy("path").agg(*[_first(find_bytes(F.col("content"), form)).alias(label) for label, form in forms])
    hits = F.array(*[F.struct(F.lit(label).alias("label"), F.col(label).alias("offset")) for label, _ in forms])
    return firsts.select("path", F.inline(hits)).filter("offset >= 0")


def context_files(spark: SparkSession, root: str, pattern: bytes, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, row_offset, hex, is_target, line)``: the rows around each file's first match.

    Only the window around a match is read again, however long the file is.
    """
    ranges = file_ranges(spark, root, glob, size, overlap=max(len(pattern) - 1, 0))
    firsts = ranges.groupBy("path", "length").agg(_first(find_bytes(F.col("content"), pattern)).alias("offset")).filter("offset >= 0")
    start = F.greatest(F.col("offset") - ROW, F.lit(0).cast("bigint"))
    # As far as the last row goes, which is shown whole.
    rows = F.ceil((F.col("offset") + len(pattern) + ROW - start) / ROW)
    windows = firsts.select("path", (F.col("offset") - start).alias("offset"), start.alias("start"), F.least(start + rows * ROW, F.col("length")).alias("stop"))
    return match_context(read_windows(windows), len(pattern), id="path", base="start")


def search_prefix_files(spark: SparkSession, root: str, target: bytes, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, prefix_len, offset)`` of files without any form of ``target``: the shortest prefix found, which is one byte."""
    forms = encodings_of(target)
    ranges = file_ranges(spark, root, glob, size, overlap=max(len(target) - 1, 0))
    held = reduce(lambda x, y: x | y, [F.contains("content", literal_bytes(form)) for _, form in forms])
    firsts = ranges.groupBy("path").agg(F.bool_or(held).alias("held"), _first(find_bytes(F.col("content"), target[:1])).alias("offset"))
    shorter = firsts.filter(~F.col("held") & (F.col("offset") >= 0) & F.lit(len(target) > 1))
    return shorter.select("path", F.lit(1).alias("prefix_len"), "offset")


def dump_files(spark: SparkSession, root: str, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, offset, hex, ascii, line)``, 16 bytes a row; none for an empty file."""
    if size % ROW:
        raise ValueError(f"a range has to hold whole rows of {ROW} bytes")
    return hex_dump(file_ranges(spark, root, glob, size), id="path", base="start")


def _summed(ranges: DataFrame, stop: Column) -> DataFrame:
    """``(path, length, computed)``: CRC32C of each file's bytes before ``stop``.

    The register is linear: what a range leaves in it, moved by the number of
    bytes that follow, is combined by exclusive or, in any order and before the
    shuffle.
    """
    held = F.greatest(F.least(F.length("content").cast("bigint"), stop - F.col("start")), F.lit(0).cast("bigint"))
    body = F.substring(F.col("content"), F.lit(1), held.cast("int"))
    after = F.greatest(stop - F.col("start") - held, F.lit(0).cast("bigint"))
    parts = ranges.select("path", "length", crc32c_part_udf(body, after).alias("part"))
    summed = parts.groupBy("path", "length").agg(F.bit_xor("part").alias("part"))
    register = F.col("part").bitwiseXOR(crc32c_start_udf(F.greatest(stop, F.lit(0).cast("bigint")))).bitwiseXOR(F.lit(ONES))
    return summed.select("path", "length", register.alias("computed"))


def checksum_files(spark: SparkSession, root: str, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, length, computed)``: the CRC32C of whole files."""
    return _summed(file_ranges(spark, root, glob, size), F.col("length"))


def verify_files(spark: SparkSession, root: str, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """``(path, computed, stored, status)``: CRC32C of all but the last eight bytes against the stored last four."""
    ranges = file_ranges(spark, root, glob, size)
    body = F.col("length") - FOOTER
    summed = _summed(ranges, body)
    # At most eight ranges hold a piece of the footer.
    from_ = F.greatest(body - F.col("start"), F.lit(0).cast("bigint")).cast("int")
    piece = F.expr("substring(content, from_ + 1)")
    pieces = ranges.filter(F.col("start") + F.length("content") > body).withColumn("from_", from_).select("path", "start", piece.alias("piece"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "piece"))), F.lit(b""), lambda x, y: F.concat(x, y["piece"]))
    footers = pieces.groupBy(F.col("path").alias("_path")).agg(joined.alias("footer"))
    both = summed.join(footers, F.col("path") == F.col("_path"), "left")
    enough = F.col("length") >= FOOTER
    judged = both.select(
        "path", F.when(enough, F.col("computed")).alias("computed"), F.when(enough, read_u32(F.col("footer"), 4, little=True)).alias("stored")
    )
    status = F.when(F.col("computed").isNull(), "too_small").when(F.col("computed") == F.col("stored"), "ok").otherwise("mismatch")
    return judged.withColumn("status", status)
