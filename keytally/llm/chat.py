"""Multi-party conversations from every participant's perspective.

For each participant the dialogue is rendered with that speaker as the
assistant and all others as named users; only the assistant's words, with the
mark that ends them, are to be learned from. The result has one row per turn and
perspective with its place in the rendered dialogue, so a conversation of any
length is never gathered: put in order, the segments are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that speak for no participant; they stay as they are in every perspective.
NOT_SPEAKERS = ("system", "tool")
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns whose places are summed up in one task.
STRETCH = 512


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), said.alias("said")
    )


def speaker_names(rows: DataFrame) -> DataFrame:
    """``(of, said_by, speaker)``: a name to show for each role of each conversation, no two alike.

    Other characters than letters, digits, ``-`` and ``_`` become ``_``, and no
    name becomes ``unknown``. Of roles that come out alike in a conversation the
    second in order, NULL first, is followed by ``#2``, the next by ``#3``.
    """
    roles = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("said_by")).distinct()
    cleaned = F.regexp_replace(F.coalesce("said_by", F.lit("")), "[^A-Za-z0-9_-]", "_")
    plain = roles.withColumn("plain", F.when(cleaned == "", UNNAMED).otherwise(cleaned))
    number = F.row_number().over(Window.partitionBy("of", "plain").orderBy(F.col("said_by").asc_nulls_first()))
    named = F.when(F.col("number") > 1, F.concat("plain", F.lit("#"), F.col("number").cast("string"))).otherwise(F.col("plain"))
    return plain.withColumn("number", number).select("of", "said_by", named.alias("speaker"))


def _head() -> Column:
    speaker = F.col("speaker")
    return (
        F.when(speaker.isin(*NOT_SPEAKERS), F.concat(F.lit(OPEN), speaker, F.lit("\n")))
        .when(speaker == F.col("perspective"), F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))
    )


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH
) -> DataFrame:
    """``(conv_id, perspective, turn, speaker, segment, start, end, mask_start, mask_end)``.

    ``start`` and ``end`` are the segment's code points in the rendered
    dialogue, ``mask_start`` and ``mask_end`` those to be learned from, NULL
    unless the speaker is the perspective. Speakers are told apart by their roles
    as they are given, NULL and an empty role too, and shown by the names of
    ``speaker_names``. NULL texts are empty, and control marks in a text are
    broken up. Turns come in order of ``turn``, NULL first, then speaker and
    text; equal rows follow each other. Rows of a NULL ``conv_id`` are one
    conversation. A conversation without participants has no rows; other
    columns are not read.
    """
    plain = _rows(turns, conv, turn, role, text)
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("role").eqNullSafe(F.col("said_by"))
    rows = plain.join(speaker_names(plain), same).drop("of", "said_by", "role")
    people = rows.filter(~F.col("speaker").isin(*NOT_SPEAKERS)).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")
    )
    both = rows.join(people.distinct(), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    both = both.withColumn("head", _head())
    length = F.length("head") + F.length("said") + len(CLOSE) + 1
    both = both.withColumns({"length": length.cast("bigint"), "stretch": F.floor(F.coalesce("turn", F.lit(-1)) / stretch)})

    place = ["conv_id", "perspective"]
    sums = both.groupBy(*place, "stretch").agg(F.sum("length").alias("sum"))
    earlier = Window.partitionBy(*place).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.struct(*place, "stretch").alias("at"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy(*place, "stretch").orderBy(F.col("turn").asc_nulls_first(), "speaker", "said")
    upto = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("upto", upto).join(starts, F.struct(*place, "stretch").eqNullSafe(F.col("at")))
    end = F.col("base") + F.col("upto")
    own = F.col("speaker") == F.col("perspective")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.concat("head", "said", F.lit(f"{CLOSE}\n")).alias("segment"),
        (end - F.col("length")).alias("start"),
        end.alias("end"),
        F.when(own, end - F.col("length") + F.length("head")).alias("mask_start"),
        F.when(own, end - 1).alias("mask_end"),
    )
