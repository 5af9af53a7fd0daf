import random

import pytest
from pyspark.sql import functions as F

from keytally.functions.checksum import append_zeros, crc32c, register_of
from keytally.operators import binary as bo
from keytally.operators import ranges as r
from keytally.sources.files import binary_files
from keytally.sources.ranges import file_ranges

rng = random.Random(1)
PATTERN = bytes.fromhex("1030405060708090")
FILES = {
    "empty.bin": b"",
    "one.bin": b"\x80",
    "exact.bin": bytes(rng.randrange(256) for _ in range(64)),
    "across.bin": b"a" * 29 + PATTERN + b"b" * 40 + PATTERN,
    "no match?.bin": PATTERN[:7] + b"\x00" + PATTERN[1:],
    "high bytes%20é.bin": bytes(range(256)) * 3,
    "pair.bin": b"x" * 30 + PATTERN[3::-1] + PATTERN[:3:-1] + b"y",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranges")
    for name, content in FILES.items():
        (root / name).write_bytes(content)
    (root / "signed.ok").write_bytes(b"body" * 20 + bytes(4) + crc32c(b"body" * 20).to_bytes(4, "little"))
    (root / "signed.bad").write_bytes(b"body" * 20 + bytes(4) + b"\x01\x02\x03\x04")
    (root / "short.ok").write_bytes(b"1234567")
    return str(root)


def name(column="path"):
    return F.substring_index(column, "/", -1).alias("name")


SIZES = [1, 16, 32, 1 << 20]


@pytest.mark.parametrize("size, overlap", [(1, 0), (7, 3), (16, 0), (32, 200), (1 << 20, 5)])
def test_ranges_cover_the_files(spark, folder, size, overlap):
    rows = file_ranges(spark, folder, "*.bin", size, overlap, partitions=4).withColumn("name", name()).collect()
    for file, content in FILES.items():
        own = sorted((x["start"], bytes(x["content"])) for x in rows if x["name"] == file)
        assert [s for s, _ in own] == list(range(0, max(len(content), 1), size))
        assert all(part == content[s : s + size + overlap] for s, part in own)
        assert {x["length"] for x in rows if x["name"] == file} == {len(content)}


@pytest.mark.parametrize("size", [1, 5, 32, 1 << 20])
def test_search_equals_whole_values(spark, folder, size):
    for pattern in (PATTERN, PATTERN[:1], b"\x00", b"zz"):
        got = dict(r.search_files(spark, folder, pattern, "*.bin", size).select(name(), "offset").collect())
        assert got == {file: content.find(pattern) for file, content in FILES.items()}
    whole = bo.search_encodings(binary_files(spark, folder, "*.bin"), PATTERN, id="path")
    got = r.search_files_encodings(spark, folder, PATTERN, "*.bin", size)
    assert {tuple(x) for x in got.select(name(), "label", "offset").collect()} == {tuple(x) for x in whole.select(name(), "label", "offset").collect()}


@pytest.mark.parametrize("size", [16, 32, 1 << 20])
def test_dump_equals_whole_values(spark, folder, size):
    whole = bo.hex_dump(binary_files(spark, folder, "*.bin"), id="path")
    got = r.dump_files(spark, folder, "*.bin", size)
    assert got.columns == whole.columns
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in whole.collect())
    with pytest.raises(ValueError, match="whole rows"):
        r.dump_files(spark, folder, size=17)


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 20])
def test_checksums_of_any_cut(spark, folder, size):
    got = {x["name"]: x["computed"] for x in r.checksum_files(spark, folder, "*.bin", size).withColumn("name", name()).collect()}
    assert got == {file: crc32c(content) for file, content in FILES.items()}
    # Whole values have no row for an empty file.
    whole = {"empty.bin": (None, None, "too_small")} | {x["name"]: x[1:] for x in bo.verify_checksum(binary_files(spark, folder)).select(name(), "computed", "stored", "status").collect()}
    parts = {x["name"]: x[1:] for x in r.verify_files(spark, folder, size=size).select(name(), "computed", "stored", "status").collect()}
    assert parts["signed.ok"][2] == "ok" and parts["signed.bad"][2] == "mismatch" and parts["short.ok"] == (None, None, "too_small")
    assert {n: p for n, p in parts.items() if p[2] != "too_small"} == {n: w for n, w in whole.items() if w[2] != "too_small"}
    assert {n for n, p in parts.items() if p[2] == "too_small"} == {n for n, w in whole.items() if w[2] == "too_small"}


def test_registers_are_combined_at_any_distance():
    import numpy as np

    for size in (0, 1, 5, 255, 256, 70_000):
        data = bytes(rng.randrange(256) for _ in range(size % 300)) + bytes(size)
        at = rng.randrange(len(data) + 1)
        after = len(data) - at
        moved = append_zeros(np.array([register_of(data[:at])], np.uint32), np.array([after]))[0]
        assert int(moved) ^ register_of(data[at:]) == register_of(data)
    far = append_zeros(np.array([7, 7], np.uint32), np.array([(1 << 40) + 3, 3]))
    again = append_zeros(far[1:], np.array([1 << 40]))
    assert far[0] == again[0]


def test_offsets_beyond_eight_digits(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc"), 0x1_2345_6780)], "id int, content binary, start bigint")
    found = bo.hex_dump(rows, base="start").first()
    assert found["offset"] == 0x1_2345_6780 and found["line"].startswith("123456780: 61 62 63")


@pytest.mark.parametrize("size", [1, 16, 40, 1 << 20])
def test_contexts_and_prefixes_equal_whole_values(spark, folder, size):
    contents = binary_files(spark, folder, "*.bin")
    for pattern in (PATTERN, b"\x80", b"bbb"):
        whole = bo.match_context(bo.byte_search(contents.withColumn("kept", F.col("content")), pattern).withColumnRenamed("kept", "content"), len(pattern), id="path")
        got = r.context_files(spark, folder, pattern, "*.bin", size)
        assert got.columns == whole.columns
        assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in whole.collect())
    for target in (b"\xe9\x01\x02\x03\x04\x05\x06\x07", PATTERN, b"a"):
        whole = bo.search_prefix(contents, target, id="path")
        got = r.search_prefix_files(spark, folder, target, "*.bin", size)
        assert {tuple(x) for x in got.collect()} == {tuple(x) for x in whole.collect()}
