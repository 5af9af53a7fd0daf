"""Byte helpers as column expressions over a BINARY column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the eight closing bytes of a state file, as stored.
STORE_SIGNATURE = bytes.fromhex("F7CFF485B741E288")


def latin1(content: Column) -> Column:
    """One character per byte, so character positions are byte positions."""
    return F.decode(content, "ISO-8859-1")


def literal_bytes(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def find_bytes(content: Column, pattern: bytes) -> Column:
    """0-based offset of the first match, -1 if there is none."""
    return F.instr(latin1(content), pattern.decode("latin-1")).cast("bigint") - 1


def signature_status(content: Column, signature: bytes = STORE_SIGNATURE) -> Column:
    """``ok``, ``bad_signature`` or ``too_small`` by the last bytes of the content."""
    size = len(signature)
    return (
        F.when(F.length(content) < size, F.lit("too_small"))
        .when(F.substring(content, -size, size) == literal_bytes(signature), F.lit("ok"))
        .otherwise(F.lit("bad_signature"))
    )


def read_u32(content: Column, start: int, little: bool) -> Column:
    """The unsigned 32-bit integer at 0-based ``start``; NULL if it is cut off."""
    digits = F.hex(F.substring(content, start + 1, 4))
    if little:
        digits = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    return F.when(F.length(content) >= start + 4, F.conv(digits, 16, 10).cast("bigint"))


def write_u32(number: Column, little: bool) -> Column:
    """Four bytes of an unsigned 32-bit integer."""
    digits = F.lpad(F.hex(number), 8, "0")
    if little:
        digits = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    return F.unhex(digits)


def spaced_hex(chunk: Column) -> Column:
    """Lower-case hex, one blank between bytes."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(chunk)), "(..)", "$1 "))


def printable(chunk: Column) -> Column:
    """The bytes as ASCII, with a dot for every byte that does not print."""
    return F.regexp_replace(latin1(chunk), r"[^\x20-\x7e]", ".")


def offset_hex(offset: Column) -> Column:
    """Eight lower-case hex digits, or as many as it takes."""
    digits = F.lower(F.hex(offset))
    return F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0"))
