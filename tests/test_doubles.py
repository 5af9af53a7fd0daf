import math
import random
import struct

from pyspark.sql import functions as F

from keytally.functions.doubles import bytes_double, double_bytes
from keytally.operators.snapshots import edit_last_n

rng = random.Random(2)
EDGES = [0.0, -0.0, 0.1, -0.1, 1.0, 2.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.2250738585072014e-308,
         2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 2.0**52 + 1, 2.0**-1022 * 1.5]
POWERS = [x for e in range(-1074, 1024, 3) for x in (math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0.0), -math.nextafter(math.ldexp(1.0, e), math.inf))]
RANDOM = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3_000)]


def test_every_double_to_bytes_and_back(spark):
    values = EDGES + POWERS + [x for x in RANDOM if not math.isnan(x)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)] + [(-1, None)], "i int, x double").repartition(4)
    rows = df.withColumn("b", double_bytes(F.col("x"))).withColumn("y", bytes_double(F.col("b"))).collect()
    for row in rows:
        if row["i"] < 0:
            assert row["b"] is None and row["y"] is None
            continue
        wanted = struct.pack(">d", values[row["i"]])
        assert bytes(row["b"]) == wanted, values[row["i"]]
        assert struct.pack(">d", row["y"]) == wanted


def test_other_lengths_are_no_double(spark):
    df = spark.createDataFrame([(bytearray(n),) for n in (0, 4, 7, 9)], "b binary")
    assert [r[0] for r in df.select(bytes_double(F.col("b"))).collect()] == [None] * 4
    nans = spark.createDataFrame([(bytearray.fromhex("fff8000000000001"),)], "b binary")
    assert math.isnan(nans.select(bytes_double(F.col("b"))).first()[0])


def test_raw_state_takes_any_double(spark):
    raw = spark.createDataFrame([(f"k{i}", bytearray(struct.pack(">d", i))) for i in range(8)], "key string, value binary")
    for value in (-2.5, 0, 1e-310, math.inf):
        got = {r["key"]: struct.unpack(">d", r["value"])[0] for r in edit_last_n(raw, 3, value, column="value").collect()}
        assert got == {f"k{i}": float(i) if i < 5 else float(value) for i in range(8)}
