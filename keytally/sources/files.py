"""Binary files and text dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def binary_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Whole files, one row each; reading only names or sizes skips the content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a text dump."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))
