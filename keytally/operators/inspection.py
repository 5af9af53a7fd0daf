"""From the last line of a dump to the place of its value in a content, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytally.functions.binary import latin1
from keytally.functions.text import hex_bytes, parse_dump_lines


def last_record_offset(
    lines: DataFrame, contents: DataFrame, id: str = "id", line: str = "value", content: str = "content"
) -> DataFrame:
    """``(id, key_hex, value_hex, offset)``: of each dump the last record by key, found in the content.

    ``lines`` are ``(id, value)`` in any order; lines that do not parse are
    passed over. Keys are compared by their bytes, and of lines with one key the
    greatest value counts. ``offset`` is 0-based, -1 if the content does not
    hold the value, which an empty value is not held by. Lines are combined per
    dump before they are shuffled.
    """
    parsed = parse_dump_lines(lines.select(id, F.col(line).alias("_line")), "_line").filter("status = 'ok'")
    order = F.struct(hex_bytes(F.col("key_hex")).alias("key"), hex_bytes(F.col("value_hex")).alias("value"))
    last = parsed.groupBy(id).agg(F.max(order).alias("_last"))
    found = contents.select(id, content).join(last, id)
    value = F.col("_last.value")
    at = F.when(F.length(value) > 0, F.instr(latin1(F.col(content)), latin1(value)).cast("bigint")).otherwise(F.lit(0))
    return found.select(
        id, F.hex("_last.key").alias("key_hex"), F.hex(value).alias("value_hex"), (at - 1).cast("bigint").alias("offset")
    )
