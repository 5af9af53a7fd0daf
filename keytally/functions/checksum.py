"""CRC32C as a vectorised UDF; Spark's own ``crc32`` uses another polynomial.

CRC is linear over bits: the register after a block is the XOR of one table
entry per byte, and a register followed by zero bytes is a fixed linear map.
Both are table look-ups on whole arrays, so no byte is visited in Python.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: the Castagnoli polynomial, bits reversed.
POLYNOMIAL = np.uint32(0x82F63B78)
BLOCK = 256
SEGMENT = 1 << 20
ONES = 0xFFFFFFFF


def _block_table() -> np.ndarray:
    """Row j: register left by each byte value at place j of a block."""
    single = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        single = (single >> np.uint32(1)) ^ (POLYNOMIAL * (single & np.uint32(1)))
    rows = [single]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ single[rows[-1] & np.uint32(255)])
    return np.array(rows[::-1])


def _advance(shift: np.ndarray, register: np.ndarray) -> np.ndarray:
    parts = [shift[i][(register >> np.uint32(8 * i)) & np.uint32(255)] for i in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _shift_tables(table: np.ndarray) -> list[np.ndarray]:
    """Maps that append BLOCK, 2*BLOCK, 4*BLOCK, ... SEGMENT zero bytes."""
    first = np.array([table[i] for i in range(4)])
    # A register byte i steps acts like message byte i of the block that follows.
    shifts = [first]
    size = BLOCK
    while size < SEGMENT:
        shifts.append(np.array([_advance(shifts[-1], row) for row in shifts[-1]]))
        size *= 2
    return shifts


TABLE = _block_table()
SHIFTS = _shift_tables(TABLE)
PLACES = np.arange(BLOCK)


def _segment(data: np.ndarray) -> np.ndarray:
    """Register after at most SEGMENT bytes, from an empty register."""
    blocks = -(-len(data) // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[len(padded) - len(data):] = data
    registers = np.bitwise_xor.reduce(TABLE[PLACES, padded.reshape(blocks, BLOCK)], axis=1)
    for shift in SHIFTS:
        if len(registers) == 1:
            break
        if len(registers) % 2:
            registers = np.concatenate([np.zeros(1, dtype=np.uint32), registers])
        registers = _advance(shift, registers[0::2]) ^ registers[1::2]
    return registers


def crc32c(data: bytes) -> int:
    if len(data) < 4:
        register = ONES
        for byte in data:
            register = (register >> 8) ^ int(TABLE[-1][(register ^ byte) & 255])
        return register ^ ONES
    # The register starts as all ones, which equals inverting the first four bytes.
    message = np.frombuffer(data, dtype=np.uint8).copy()
    message[:4] ^= 255
    first = len(message) % SEGMENT or SEGMENT
    register = _segment(message[:first])
    for at in range(first, len(message), SEGMENT):
        register = _advance(SHIFTS[-1], register) ^ _segment(message[at:at + SEGMENT])
    return int(register[0]) ^ ONES


@cache
def _append_maps() -> list[np.ndarray]:
    """Maps that append 1, 2, 4, ... 2**62 zero bytes to a register."""
    byte = np.arange(256, dtype=np.uint32)
    single = TABLE[-1]
    maps = [np.array([single, *[byte << np.uint32(8 * (i - 1)) for i in (1, 2, 3)]])]
    for _ in range(62):
        maps.append(np.array([_advance(maps[-1], row) for row in maps[-1]]))
    return maps


def append_zeros(registers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each register after ``counts`` zero bytes, by the binary digits of the counts."""
    moved = registers.astype(np.uint32)
    for k, shift in enumerate(_append_maps()):
        chosen = (counts >> k) & 1 == 1
        if chosen.any():
            moved[chosen] = _advance(shift, moved[chosen])
        elif not (counts >> k).any():
            break
    return moved


def register_of(data: bytes) -> int:
    """What the bytes leave in an empty register."""
    if not data:
        return 0
    message = np.frombuffer(data, dtype=np.uint8)
    first = len(message) % SEGMENT or SEGMENT
    register = _segment(message[:first])
    for at in range(first, len(message), SEGMENT):
        register = _advance(SHIFTS[-1], register) ^ _segment(message[at:at + SEGMENT])
    return int(register[0])


@F.pandas_udf(LongType())
def crc32c_part_udf(content: pd.Series, after: pd.Series) -> pd.Series:
    """What a range of a message adds to its register, ``after`` bytes before its end."""
    registers = np.array([register_of(data) for data in content], np.uint32)
    return pd.Series(append_zeros(registers, after.to_numpy(np.int64)).astype(np.int64))


@F.pandas_udf(LongType())
def crc32c_start_udf(length: pd.Series) -> pd.Series:
    """What the ones that a register starts with become over a message of ``length`` bytes."""
    counts = length.to_numpy(np.int64)
    return pd.Series(append_zeros(np.full(len(counts), ONES, np.uint32), counts).astype(np.int64))


@F.pandas_udf(LongType())
def crc32c_udf(content: pd.Series) -> pd.Series:
    return content.map(crc32c, na_action="ignore").astype("Int64")
