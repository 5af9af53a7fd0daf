"""Text helpers as column expressions: ids, paths, hex text, dump lines, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text formats that are read and written.
JOB_ID = r"JobID ([a-f0-9]{32})"
SNAPSHOT_PATH = r"(?md)^.*Path: file:(\S*)"
ARROW = " => "


def _first_group(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def extract_job_id(text: Column) -> Column:
    """The id after ``JobID``, or NULL."""
    return _first_group(text, JOB_ID)


def extract_path(text: Column) -> Column:
    """The path after the last ``Path: file:`` of the first line that has one, or NULL."""
    return _first_group(text, SNAPSHOT_PATH)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def has_suffix(path: Column, suffix: str = ".sst", is_directory: Column | None = None) -> Column:
    """True for a regular file whose path ends with ``suffix``."""
    matches = F.endswith(path, F.lit(suffix))
    return matches if is_directory is None else ~is_directory & matches


def sanitize_hex(text: Column) -> Column:
    """Only the hex digits of ``text``, without an odd last one."""
    digits = F.regexp_replace(text, "[^0-9a-fA-F]+", "")
    return F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % 2)


def is_hex(text: Column) -> Column:
    """Whole bytes of hex digits; plain loops, as texts may be long."""
    return (F.length(text) % 2 == 0) & ~text.rlike("[^0-9a-fA-F]")


def hex_bytes(text: Column) -> Column:
    """Bytes of a hex string with optional white space or colons; NULL if it is not hex."""
    digits = F.regexp_replace(text, "[ \\t-\\r:]", "")
    return F.when(is_hex(digits), F.unhex(digits))


def _offset_forms(text: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a text is a decimal or a hexadecimal number, its sign, and its bare digits."""
    plain = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    grouped = ~plain.contains("__") & ~F.endswith(plain, F.lit("_"))
    decimal = grouped & plain.rlike("^[+-]?[0-9][0-9_]*$")
    hexadecimal = grouped & plain.rlike("^[+-]?(0[xX]_?)?[0-9a-fA-F][0-9a-fA-F_]*$")
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return decimal, hexadecimal, sign, F.regexp_replace(plain, r"^[+-]|_", "")


def parse_offset(text: Column) -> Column:
    """A decimal, else a hexadecimal number (``0x`` optional); NULL otherwise.

    Both allow a sign, outer blanks and single underscores between digits.
    ``offset_status`` tells a number beyond 64 bits from a text that is none.
    """
    decimal, hexadecimal, sign, digits = _offset_forms(text)
    hex_digits = F.regexp_replace(F.regexp_replace(digits, "^0[xX]", ""), "^0+(?=.)", "")
    return F.when(decimal, F.concat(sign, digits).try_cast("bigint")).when(
        hexadecimal & (F.length(hex_digits) <= 16), F.concat(sign, F.conv(hex_digits, 16, 10)).try_cast("bigint")
    )


def offset_status(text: Column) -> Column:
    """``ok``, ``too_large`` for a number beyond 64 bits, or ``not_a_number``."""
    decimal, hexadecimal, _, _ = _offset_forms(text)
    number = F.coalesce(decimal | hexadecimal, F.lit(False))
    return F.when(~number, "not_a_number").when(parse_offset(text).isNull(), "too_large").otherwise("ok")


def render_tuple(word: Column, n: Column) -> Column:
    """The printed form ``(word,n)``; a missing word or number prints as ``null``."""
    parts = [F.coalesce(part.cast("string"), F.lit("null")) for part in (word, n)]
    return F.concat(F.lit("("), parts[0], F.lit(","), parts[1], F.lit(")"))


def parse_tuple(text: Column) -> tuple[Column, Column]:
    """``word`` and ``n`` out of the printed form; NULL where a line is not one."""
    pattern = r"(?s)^\((.*),([0-9]+)\)$"
    good = text.rlike(pattern)
    word = F.when(good, F.regexp_extract(text, pattern, 1))
    n = F.when(good, F.regexp_extract(text, pattern, 2).try_cast("bigint"))
    return word, n


def render_dump_line(key_hex: Column, seq: Column, value_hex: Column) -> Column:
    """A dump line: ``'<key>' seq:<n>, type:1 => <value>``."""
    return F.concat(
        F.lit("'"), key_hex, F.lit("' seq:"), seq.cast("string"), F.lit(", type:1 => "), value_hex
    )


def parse_dump_lines(lines: DataFrame, column: str = "value", quoted_only: bool = False) -> DataFrame:
    """Add ``key_hex, value_hex, status`` to dump lines; no line is dropped.

    ``status`` is ``ok``, ``no_arrow`` (nothing to split on) or ``bad_hex``.
    The key is the text between the first two quotes, else the hex digits of
    the left side; with ``quoted_only`` an unquoted key is NULL and the value
    is only trimmed.
    """
    line = F.col(column)
    split_at = F.instr(line, ARROW)
    has_arrow = split_at > 0
    left = F.when(has_arrow, F.substring(line, F.lit(1), split_at - 1))
    right = F.when(has_arrow, F.substring(line, split_at + len(ARROW), F.length(line)))
    quoted = left.rlike("'[^']*'")
    inside = F.regexp_extract(left, "'([^']*)'", 1)
    if quoted_only:
        key, value = F.when(quoted, inside), F.trim(right)
    else:
        key, value = F.when(quoted, inside).otherwise(sanitize_hex(left)), sanitize_hex(right)
    parsed = lines.withColumns({"key_hex": key, "value_hex": value})
    bad = ~F.coalesce(is_hex(F.col("key_hex")), F.lit(True)) | ~is_hex(F.col("value_hex"))
    return parsed.withColumn(
        "status",
        F.when(F.instr(F.col(column), ARROW) == 0, F.lit("no_arrow"))
        .when(bad, F.lit("bad_hex"))
        .otherwise(F.lit("ok")),
    )
