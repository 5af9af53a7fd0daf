"""Ordered k-letter vocabularies and seeded uniform draws from them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = 26
#: A vocabulary of fewer words is copied to about so many, for the join.
SALTED_WORDS = 10_000


def combination(index: Column, length: int) -> Column:
    """The ``index``-th of the ``26**length`` combinations in lexical order."""
    letters = []
    for power in range(length - 1, -1, -1):
        digit = F.call_function("div", index, F.lit(LETTERS**power)) % LETTERS
        letters.append(F.char(digit + 97))
    return F.concat(*letters)


def vocabulary(spark: SparkSession, length: int = 3) -> DataFrame:
    """All combinations as ``(id, word)``; generated on the executors."""
    return spark.range(LETTERS**length).select("id", combination(F.col("id"), length).alias("word"))


def vocabulary_stats(draws: DataFrame, length: int = 3) -> DataFrame:
    """Vocabulary size, number of draws, and draws per combination."""
    total = LETTERS**length
    return draws.agg(F.count(F.lit(1)).alias("draws")).select(
        F.lit(total).cast("bigint").alias("combinations"),
        "draws",
        (F.col("draws") / F.lit(float(total))).alias("per_combination"),
        F.format_string("%.1f", F.col("draws") / F.lit(float(total))).alias("per_combination_text"),
    )


def draw_index(row_id: Column, seed: int, size: int | Column) -> Column:
    """A uniform index below ``size``, fixed by the row and the seed.

    60 bits of MD5: the same row draws the same word on every retry, and the
    bias of the remainder is below ``size / 2**60``.
    """
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return number % size


def draw_words(rows: DataFrame, row_id: str, seed: int, length: int = 3) -> DataFrame:
    """One word of the k-letter vocabulary per row, as ``(seq, word)``.

    The word follows from the index by arithmetic, so nothing is joined.
    """
    index = draw_index(F.col(row_id), seed, LETTERS**length)
    return rows.select(F.col(row_id).alias("seq"), combination(index, length).alias("word"))


def bucketed_words(words: DataFrame, word: str = "word") -> DataFrame:
    """The distinct words as ``(bucket, word)``, to be stored for ``draw_from``.

    The bucket is three hex digits of the word's MD5.
    """
    found = words.select(F.col(word).alias("word")).distinct()
    return found.select(F.substring(F.md5("word"), 1, 3).alias("bucket"), "word")


def draw_from(rows: DataFrame, row_id: str, entries: DataFrame, seed: int) -> DataFrame:
    """One word per row, drawn from stored ``bucketed_words``; an empty set is an error.

    The words are numbered 0..n-1 in order of ``(bucket, word)``. Each of 4,096
    windows sorts its share, and where a bucket starts is a table of at most
    4,096 rows. Rows meet their word by its bucket and place in it, salted by
    the row, as with few words each one is drawn by many rows.
    """
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).orderBy("bucket").collect()
    ends = list(accumulate(size["c"] for size in sizes))
    if not ends:
        raise ValueError("the vocabulary is empty")
    starts = rows.sparkSession.createDataFrame(
        [(size["bucket"], end - size["c"]) for size, end in zip(sizes, ends)], "bucket string, start bigint"
    )
    # Words so few that each is drawn often are copied, to have the rows of one spread.
    salts = max(1, SALTED_WORDS // ends[-1])
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("word"))
    indexed = entries.withColumn("i", within).join(F.broadcast(starts), "bucket")
    numbered = indexed.select(
        (F.col("start") + F.col("i") - 1).alias("id"), "word", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    draws = rows.select(
        F.col(row_id).alias("seq"),
        draw_index(F.col(row_id), seed, ends[-1]).alias("id"),
        F.pmod(F.hash(row_id), F.lit(salts)).alias("salt"),
    )
    return draws.join(numbered, ["id", "salt"]).select("seq", "word")
