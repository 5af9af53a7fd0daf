"""Doubles as eight big-endian bytes and back, by column arithmetic.

A double is its sign, eleven bits of exponent and 52 of mantissa. Each part is
found by exact arithmetic: dividing by a power of two loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keytally.functions.binary import read_u32

# Fixed values of the 64-bit format.
BIAS, LEAST_EXPONENT, MANTISSA_BITS = 1023, -1022, 52
INFINITE, NOT_A_NUMBER = 0x7FF << 52, 0x7FF8 << 48
_SIGN = -(1 << 63)


def _power(exponent: Column | int) -> Column:
    """Two to an integer power, exactly."""
    return F.pow(F.lit(2.0), exponent if isinstance(exponent, Column) else F.lit(exponent))


def double_bits(x: Column) -> Column:
    """The bits as ``bigint``; every NaN has the same ones."""
    x = x.cast("double")
    size = F.abs(x)
    # The logarithm may be off by one next to a power of two.
    near = F.when(size > 0, F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT)))
    near = F.least(near, F.lit(BIAS))
    exponent = F.when(size / _power(near) >= 2, near + 1).when((size / _power(near) < 1) & (near > LEAST_EXPONENT), near - 1).otherwise(near)
    scaled = size / _power(exponent)
    fraction = ((scaled - 1) * _power(MANTISSA_BITS)).cast("bigint")
    normal = F.shiftleft((exponent + BIAS).cast("bigint"), MANTISSA_BITS).bitwiseOR(fraction)
    small = (size / _power(LEAST_EXPONENT - MANTISSA_BITS)).cast("bigint")
    bits = (
        F.when(F.isnan(x), F.lit(NOT_A_NUMBER))
        .when(size == F.lit(float("inf")), F.lit(INFINITE))
        .when(size < F.lit(2.0**LEAST_EXPONENT), small)
        .otherwise(normal)
    )
    negative = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    return F.when(x.isNotNull(), F.when(negative & ~F.isnan(x), bits.bitwiseOR(F.lit(_SIGN))).otherwise(bits))


def double_bytes(x: Column) -> Column:
    """Eight bytes, the most significant first."""
    return F.unhex(F.lpad(F.hex(double_bits(x)), 16, "0"))


def bytes_double(content: Column) -> Column:
    """The double in eight bytes; NULL for any other length."""
    high, low = read_u32(content, 0, little=False), read_u32(content, 4, little=False)
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    mantissa = F.shiftleft(high.bitwiseAND(F.lit(0xFFFFF)), 32).bitwiseOR(low).cast("double")
    size = (
        F.when((exponent == 0x7FF) & (mantissa > 0), F.lit(float("nan")))
        .when(exponent == 0x7FF, F.lit(float("inf")))
        .when(exponent == 0, mantissa * _power(LEAST_EXPONENT - MANTISSA_BITS))
        .otherwise((1 + mantissa / _power(MANTISSA_BITS)) * _power(exponent - BIAS))
    )
    return F.when(F.length(content) == 8, F.when(high >= 1 << 31, -1.0 * size).otherwise(size))
