"""Search, patch, dump, and check many binary contents ``(id, content)`` at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.functions.binary import (
    find_bytes,
    literal_bytes,
    offset_hex,
    printable,
    read_u32,
    spaced_hex,
)
from keytally.functions.checksum import crc32c_udf
from keytally.functions.text import hex_bytes, parse_offset, sanitize_hex

ROW = 16
PATCH_MARK, MATCH_MARK = " <== patch at ", "  <== match at "


def byte_search(rows: DataFrame, pattern: bytes, content: str = "content") -> DataFrame:
    """Replace the content by ``offset``: the first match, 0-based, -1 if absent."""
    return rows.withColumn("offset", find_bytes(F.col(content), pattern)).drop(content)


def encodings_of(target: bytes) -> list[tuple[str, bytes]]:
    """The forms a value may be stored in: as it is and, for eight bytes read as
    two big-endian integers, both or either of them little-endian."""
    forms = [("exact", target)]
    if len(target) == 8:
        high, low = target[:4], target[4:]
        forms += [("pair_le", high[::-1] + low[::-1]), ("first_le", high[::-1]), ("second_le", low[::-1])]
    return forms


def search_encodings(rows: DataFrame, target: bytes, id: str = "id", content: str = "content") -> DataFrame:
    """``(id, label, offset, pattern)`` for each form of ``target`` that is found.

    All offsets are computed in one projection, which decodes the content once,
    and only the short results are exploded: no pattern table is joined.
    """
    searched = rows.select(id, _hits(F.col(content), encodings_of(target)).alias("hits"))
    # The array is never empty; a plain inline would compute it twice to test that.
    return searched.select(id, F.inline_outer("hits")).filter("offset >= 0")


def _hits(content: Column, forms: list[tuple[str, bytes]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                find_bytes(content, pattern).alias("offset"),
                literal_bytes(pattern).alias("pattern"),
            )
            for label, pattern in forms
        ]
    )


def search_prefix(rows: DataFrame, target: bytes, id: str = "id", content: str = "content") -> DataFrame:
    """Contents without any form of ``target``: the shortest prefix found in them.

    A content that has a longer prefix has its first byte too, so the shortest
    one found is always one byte long; a target of one byte has no prefix.
    """
    if len(target) < 2:
        return rows.select(id, F.lit(1).alias("prefix_len"), F.lit(-1).cast("bigint").alias("offset")).limit(0)
    missing = F.lit(True)
    for _, pattern in encodings_of(target):
        missing = missing & ~F.contains(F.col(content), literal_bytes(pattern))
    return (
        rows.filter(missing)
        .select(id, F.lit(1).alias("prefix_len"), find_bytes(F.col(content), target[:1]).alias("offset"))
        .filter("offset >= 0")
    )


def patch(rows: DataFrame, offset: Column, new_hex: Column, content: str = "content") -> DataFrame:
    """Overwrite bytes at ``offset`` where they lie inside the content.

    Adds ``status`` (``ok``, ``bad_hex``, ``out_of_range``, ``too_long``) and
    ``original``; a refused patch leaves the content as it is. ``overlay`` alone
    would append past the end.
    """
    prepared = rows.withColumns({"_at": offset.cast("bigint"), "_new": hex_bytes(new_hex)})
    size, at, new = F.length(content), F.col("_at"), F.col("_new")
    status = (
        F.when(new.isNull(), F.lit("bad_hex"))
        .when(at.isNull() | (at < 0) | (at >= size), F.lit("out_of_range"))
        .when(at + F.length(new) > size, F.lit("too_long"))
        .otherwise(F.lit("ok"))
    )
    judged = prepared.withColumn("status", status)
    place = (at + 1).cast("int")
    good = F.col("status") == "ok"
    return judged.withColumns(
        {
            "original": F.when(good, F.substring(F.col(content), place, F.length(new))),
            content: F.when(good, F.overlay(F.col(content), new, place)).otherwise(F.col(content)),
        }
    ).drop("_at", "_new")


def hex_dump(rows: DataFrame, id: str = "id", content: str = "content", base: str | None = None) -> DataFrame:
    """``(id, offset, hex, ascii, line)``, 16 bytes a row; none for empty content.

    ``base`` names the place of a content in a longer one, that offsets start at.
    """
    starts = F.sequence(F.lit(0), F.length(content) - 1, F.lit(ROW))
    kept = [F.col(base).alias("_base")] if base else []
    numbered = rows.filter(F.length(content) > 0).select(id, content, *kept, F.explode(starts).alias("_row"))
    chunk = F.substring(F.col(content), F.col("_row") + 1, F.lit(ROW))
    offset = F.col("_row") + F.col("_base") if base else F.col("_row")
    numbered = numbered.withColumn("offset", offset)
    cells = F.regexp_replace(F.lower(F.hex("chunk")), "(..)", "$1 ")
    shown = numbered.select(id, "offset", chunk.alias("chunk")).select(
        id, "offset", cells.alias("cells"), printable(F.col("chunk")).alias("ascii")
    )
    return shown.select(
        id,
        "offset",
        F.rtrim("cells").alias("hex"),
        "ascii",
        _dump_line(F.col("offset"), F.col("cells"), F.col("ascii")).alias("line"),
    )


def _dump_line(offset: Column, cells: Column, text: Column) -> Column:
    """``00000010: 00 .. 07  08 .. 0f  |text|``, short rows filled with blanks."""
    left, right = [F.rpad(F.substring(cells, start, 24), 24, " ") for start in (1, 25)]
    return F.concat(offset_hex(offset), F.lit(": "), left, F.lit(" "), right, F.lit(" |"), text, F.lit("|"))


def _context(
    rows: DataFrame, id: str, content: str, start: Column, stop: Column, whole_rows: bool, mark: str, extra: tuple[str, ...] = (), base: str | None = None
) -> DataFrame:
    """Rows of 16 bytes from ``start`` to ``stop``; the one with ``offset`` is marked.

    ``base`` names the place of a content in a longer one; all are counted from
    the content's start, and shown from that of the longer one.

    Both are cut to the content before they become positions in it, so an
    offset far outside shows nothing.
    """
    size = F.length(content).cast("bigint")
    bounded = rows.withColumns({"_start": F.least(start, size).cast("int"), "_stop": F.least(stop, size).cast("int")})
    split = bounded.filter(F.col("_start") < F.col("_stop")).select(
        id,
        content,
        "offset",
        "_stop",
        *extra,
        *([base] if base else []),
        F.explode(F.expr(f"sequence(_start, _stop - 1, {ROW})")).alias("row_offset"),
    )
    width = F.lit(ROW) if whole_rows else F.least(F.lit(ROW), F.col("_stop") - F.col("row_offset"))
    inside = (F.col("offset") >= F.col("row_offset")) & (F.col("offset") < F.col("row_offset") + ROW)
    text = spaced_hex(F.substring(F.col(content), F.col("row_offset") + 1, width))
    shown, place = [F.col(c) + F.col(base) if base else F.col(c) for c in ("row_offset", "offset")]
    marker = F.when(inside, F.concat(F.lit(mark), place.cast("string"))).otherwise(F.lit(""))
    return split.select(
        id,
        shown.alias("row_offset"),
        *extra,
        text.alias("hex"),
        inside.alias("is_target"),
        F.concat(offset_hex(shown), F.lit(": "), F.rpad(text, 47, " "), marker).alias("line"),
    )


def patch_context(rows: DataFrame, id: str = "id", content: str = "content", before: int = ROW) -> DataFrame:
    """The bytes around ``offset``: ``before`` bytes ahead of it, then ``before + 16``."""
    start = F.greatest(F.lit(0).cast("bigint"), F.col("offset").cast("bigint") - before)
    stop = start + 2 * before + ROW
    return _context(rows, id, content, start, stop, False, PATCH_MARK)


def match_context(
    rows: DataFrame, length: int | Column, id: str = "id", content: str = "content", extra: tuple[str, ...] = (), base: str | None = None
) -> DataFrame:
    """The rows around a match of ``length`` bytes at ``offset``, 16 bytes to each side.

    The length may be a column, as matches of different forms have different
    ones. The last row is shown whole even where it passes the window. Columns
    named in ``extra`` are kept.
    """
    offset = F.col("offset").cast("bigint")
    width = length if isinstance(length, Column) else F.lit(length)
    found = rows.filter(F.col("offset") >= 0)
    start = F.greatest(F.lit(0).cast("bigint"), offset - ROW)
    return _context(found, id, content, start, offset + width + ROW, True, MATCH_MARK, extra, base)


def encoding_contexts(rows: DataFrame, target: bytes, id: str = "id", content: str = "content") -> DataFrame:
    """The context of every form of ``target`` that is found, by ``label``.

    Contents without any form show their shortest prefix instead, labelled ``prefix``.
    """
    forms = encodings_of(target)
    hits = _hits(F.col(content), forms)
    prefix = F.array(
        F.struct(
            F.lit("prefix").alias("label"),
            find_bytes(F.col(content), target[:1]).alias("offset"),
            literal_bytes(target[:1]).alias("pattern"),
        )
    )
    found = F.filter("_hits", lambda hit: hit["offset"] >= 0)
    listed = rows.withColumn("_hits", hits).withColumn("_hits", found)
    chosen = F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(prefix if len(target) > 1 else F.col("_hits"))
    each = listed.select(id, content, F.explode(chosen).alias("_hit")).select(
        id, content, "_hit.label", "_hit.offset", F.length("_hit.pattern").alias("length")
    )
    return match_context(each, F.col("length"), id, content, ("label",))


def patch_requests(
    rows: DataFrame, offset_text: Column, hex_text: Column, id: str = "id", content: str = "content"
) -> DataFrame:
    """Patches asked for in text: the status of each, and the bytes around its place before and after.

    The offset is read by ``parse_offset`` and the new bytes from the hex digits
    of ``hex_text``. A refused patch has no context.
    """
    asked = rows.withColumns({"offset": parse_offset(offset_text), "_digits": sanitize_hex(hex_text)})
    done = patch(asked.withColumn("_before", F.col(content)), F.col("offset"), F.col("_digits"), content)

    def around(data: str) -> Column:
        at = F.col("offset")
        start = F.greatest(F.lit(0).cast("bigint"), at - ROW)
        shown = spaced_hex(F.substring(F.col(data), (start + 1).cast("int"), F.lit(3 * ROW)))
        return F.when(F.col("status") == "ok", shown)

    return done.select(id, "offset", "status", around("_before").alias("before"), around(content).alias("after"))


def verify_checksum(rows: DataFrame, content: str = "content") -> DataFrame:
    """CRC32C of all but the last eight bytes against the stored last four.

    Adds ``computed, stored, status`` (``ok``, ``mismatch``, ``too_small``) and
    drops the content; nothing is written back.
    """
    body = F.when(
        F.length(content) >= 8,
        F.substring(F.col(content), F.lit(1), F.length(content) - 8),
    )
    footer = F.substring(content, -8, 8)
    summed = rows.withColumns({"computed": crc32c_udf(body), "stored": read_u32(footer, 4, little=True)})
    return summed.withColumn(
        "status",
        F.when(F.col("computed").isNull(), F.lit("too_small"))
        .when(F.col("computed") == F.col("stored"), F.lit("ok"))
        .otherwise(F.lit("mismatch")),
    ).drop(content)
