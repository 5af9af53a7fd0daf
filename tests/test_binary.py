"""Byte operators against plain Python on small contents."""

import random

import pytest
from pyspark.sql import functions as F

from keytally.functions.binary import STORE_SIGNATURE, find_bytes, read_u32, signature_status, write_u32
from keytally.functions.checksum import SEGMENT, crc32c
from keytally.operators import binary as b
from keytally.operators import inspection

SCHEMA = "id int, content binary"
EDGES = [
    b"", b"a", b"\x00", bytes.fromhex("10304055"), bytes.fromhex("C3A9C3A900300304"),
    "é<p>ü".encode(), b"0123456789abcdef", b"0123456789abcdefg", bytes(range(256)), b"\n\r\x00\xff" * 9,
]


def contents(seed=0):
    rng = random.Random(seed)
    return EDGES + [bytes(rng.choice(b"\x00\x01<p>\xc3\xa9") for _ in range(rng.randrange(60))) for _ in range(40)]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), SCHEMA)


PATTERNS = [
    b"<p", b"\x03\x04", b"\x00", b"\xc3\xa9", b"a", b"g", b"\xff", b"zz", b"",
    bytes.fromhex("10304055"), b"\x00\x01\x00\x01", b"\n\r\x00\xff",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_byte_search(spark, pattern):
    values = contents()
    got = {r.id: r.offset for r in b.byte_search(frame(spark, values), pattern).collect()}
    assert got == {i: v.find(pattern) for i, v in enumerate(values)}


def test_search_does_not_match_across_nibbles(spark):
    got = b.byte_search(frame(spark, [bytes.fromhex("10304055"), bytes.fromhex("C3A9C3A900300304")]), b"\x03\x04")
    assert [r.offset for r in got.orderBy("id").collect()] == [-1, 6]


def python_encodings(value, target):
    forms = [("exact", target)]
    if len(target) == 8:
        first, second = int.from_bytes(target[:4], "big"), int.from_bytes(target[4:], "big")
        forms.append(("pair_le", first.to_bytes(4, "little") + second.to_bytes(4, "little")))
        forms.append(("first_le", first.to_bytes(4, "little")))
        forms.append(("second_le", second.to_bytes(4, "little")))
    return [(label, value.find(p), p) for label, p in forms if value.find(p) >= 0]


@pytest.mark.parametrize("target", [bytes.fromhex("0000000400000001"), b"<p", b"\x01\x00\xc3\xa9<p>\x00"])
def test_search_encodings_and_prefix(spark, target):
    stored = bytes.fromhex("0400000001000000")
    values = contents(1) + [b"xx" + stored, stored[:4] + b"x" + stored[4:], target, b"pad" + target]
    df = frame(spark, values)
    got = {(r.id, r.label, r.offset, bytes(r.pattern)) for r in b.search_encodings(df, target).collect()}
    assert got == {(i, *hit) for i, v in enumerate(values) for hit in python_encodings(v, target)}

    wanted = set()
    for i, v in enumerate(values):
        if not python_encodings(v, target):
            for size in range(1, len(target)):
                if v.find(target[:size]) >= 0:
                    wanted.add((i, size, v.find(target[:size])))
                    break
    assert {tuple(r) for r in b.search_prefix(df, target).collect()} == wanted


def test_prefix_of_one_byte_target_is_none(spark):
    assert b.search_prefix(frame(spark, EDGES), b"z").count() == 0


PATCHES = [
    (0, "05", "ok"), (3, "0500", "ok"), (4, "05:0 0", "ok"), (5, "05", "ok"), (5, "0500", "too_long"),
    (6, "05", "out_of_range"), (-1, "05", "out_of_range"), (None, "05", "out_of_range"), (0, "0G", "bad_hex"),
    (0, "050", "bad_hex"), (2, "", "ok"), (0, "AABBCCDDEEFF", "ok"), (0, "AABBCCDDEEFF00", "too_long"),
]


def test_patch(spark):
    content = b"abcdef"
    df = spark.createDataFrame(
        [(i, content, at, new) for i, (at, new, _) in enumerate(PATCHES)], "id int, content binary, at bigint, new string"
    )
    for r in b.patch(df, F.col("at"), F.col("new")).collect():
        at, new, status = PATCHES[r.id]
        assert r.status == status, PATCHES[r.id]
        if status == "ok":
            data = bytes.fromhex(new.replace(" ", "").replace(":", ""))
            assert bytes(r.original) == content[at:at + len(data)]
            assert bytes(r.content) == content[:at] + data + content[at + len(data):]
        else:
            assert r.original is None and bytes(r.content) == content


def python_line(offset, chunk):
    cells = [f"{x:02x} " for x in chunk] + ["   "] * (16 - len(chunk))
    text = "".join(chr(x) if 32 <= x < 127 else "." for x in chunk)
    return f"{offset:08x}: {''.join(cells[:8])} {''.join(cells[8:])} |{text}|"


def test_hex_dump(spark):
    values = contents(2)
    got = {(r.id, r.offset): (r.hex, r.ascii, r.line) for r in b.hex_dump(frame(spark, values)).collect()}
    wanted = {}
    for i, v in enumerate(values):
        for at in range(0, len(v), 16):
            chunk = v[at:at + 16]
            text = "".join(chr(x) if 32 <= x < 127 else "." for x in chunk)
            wanted[i, at] = (chunk.hex(" "), text, python_line(at, chunk))
    assert got == wanted


@pytest.mark.parametrize("before", [16, 10])
def test_patch_context(spark, before):
    value = bytes(range(100))
    offsets = [-5, 0, 3, 16, 17, 50, 95, 99, 100, 130]
    df = spark.createDataFrame([(o, value, o) for o in offsets], "id int, content binary, offset int")
    got = {(r.id, r.row_offset): (r.is_target, r.line) for r in b.patch_context(df, before=before).collect()}
    wanted = {}
    for o in offsets:
        start = max(0, o - before)
        data = value[start:start + 2 * before + 16]
        for i in range(0, len(data), 16):
            hit = start + i <= o < start + i + 16
            mark = f" <== patch at {o}" if hit else ""
            wanted[o, start + i] = (hit, f"{start + i:08x}: {data[i:i + 16].hex(' ').ljust(47)}{mark}")
    assert got == wanted


def test_far_offsets_show_nothing(spark):
    offsets = [2**40, -1, -(2**40), 5, None]
    df = spark.createDataFrame([(i, bytes(40), o) for i, o in enumerate(offsets)], "id int, content binary, offset bigint")
    assert {r.id for r in b.match_context(df, 4).collect()} == {3}
    shown = b.patch_context(df).groupBy("id").count().collect()
    assert {r["id"] for r in shown} == {1, 2, 3, 4}


def test_contexts_of_all_forms(spark):
    target = bytes.fromhex("0000000400000001")
    values = [b"x" * 20 + bytes.fromhex("0400000001000000") + b"y" * 20, b"y" * 9 + b"\0" + b"y" * 9, b"none", target]
    got = {}
    for r in b.encoding_contexts(frame(spark, values), target).collect():
        if r.is_target:
            got.setdefault(r.id, set()).add((r.label, int(r.line.rsplit(" ", 1)[1])))
    assert got == {0: {("pair_le", 20), ("first_le", 20), ("second_le", 24)}, 1: {("prefix", 9)}, 3: {("exact", 0), ("first_le", 3)}}


def test_patches_asked_for_in_text(spark):
    rows = [
        (1, bytes(40), "0x10", "aa:bb"), (2, bytes(40), "39", "aabb"), (3, bytes(4), "zz", "aa"), (4, bytes(4), "1", "a-a b"),
    ]
    df = spark.createDataFrame(rows, "id int, content binary, at string, new string")
    got = {r.id: (r.offset, r.status, r.before, r.after) for r in b.patch_requests(df, F.col("at"), F.col("new")).collect()}
    zero = lambda n: " ".join(["00"] * n)
    assert got == {
        1: (16, "ok", zero(40), f"{zero(16)} aa bb {zero(22)}"), 2: (39, "too_long", None, None),
        3: (None, "out_of_range", None, None), 4: (1, "ok", zero(4), "00 aa 00 00"),
    }


def test_last_record_offset(spark):
    lines = [
        (1, "'0a' seq:1 => 6162"), (1, "'0b' seq:9 => 6364"), (1, "no record"), (1, "'xy' => 00"),
        (2, "'01' seq:1 => 99"), (3, "'01' seq:1 => "), (4, "nothing"),
    ]
    pages = [(1, b"abcdcd"), (2, b"abc"), (3, b"abc"), (4, b"abc"), (5, b"abc")]
    got = inspection.last_record_offset(
        spark.createDataFrame(lines, "id int, value string"), spark.createDataFrame(pages, "id int, content binary")
    )
    assert sorted(tuple(r) for r in got.collect() if r.id != 1) == [(2, "01", "99", -1), (3, "01", "", -1)]
    one = [tuple(r) for r in got.filter("id = 1").collect()]
    assert one == [(1, "0B", "6364", 2)]


@pytest.mark.parametrize("length", [2, 8, 20])
def test_match_context(spark, length):
    value = bytes(range(100))
    offsets = [-1, 0, 3, 16, 17, 50, 95, 99]
    df = spark.createDataFrame([(o, value, o) for o in offsets], "id int, content binary, offset int")
    got = {(r.id, r.row_offset): (r.is_target, r.line) for r in b.match_context(df, length).collect()}
    wanted = {}
    for o in offsets[1:]:
        for i in range(max(0, o - 16), min(100, o + length + 16), 16):
            mark = f" <== match at {o}" if i <= o < i + 16 else ""
            line = f"{i:08x}: {value[i:i + 16].hex(' ').ljust(47)} {mark}"
            wanted[o, i] = (bool(mark), line)
    trimmed = {k: (hit, line.rstrip()) for k, (hit, line) in got.items()}
    assert trimmed == {k: (hit, line.rstrip()) for k, (hit, line) in wanted.items()}


def slow_crc32c(data):
    register = 0xFFFFFFFF
    for x in data:
        register ^= x
        for _ in range(8):
            register = (register >> 1) ^ (0x82F63B78 * (register & 1))
    return register ^ 0xFFFFFFFF


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283
    rng = random.Random(3)
    for size in [0, 1, 3, 4, 5, 255, 256, 257, 512, 4000, SEGMENT + 3]:
        data = rng.randbytes(size)
        assert crc32c(data) == slow_crc32c(data), size


def test_verify_checksum(spark):
    body = b"some content" * 50
    footer = b"padd" + slow_crc32c(body).to_bytes(4, "little")
    broken = b"x" + body[1:] + footer
    empty_body = b"padd" + bytes(4)
    df = frame(spark, [body + footer, broken, b"short", empty_body])
    got = {r.id: (r.status, r.computed) for r in b.verify_checksum(df).collect()}
    assert got[0] == ("ok", slow_crc32c(body))
    assert got[1][0] == "mismatch"
    assert got[2] == ("too_small", None)
    assert got[3] == ("ok", 0)


def test_signature(spark):
    df = frame(spark, [b"x" + STORE_SIGNATURE, STORE_SIGNATURE, STORE_SIGNATURE[1:], STORE_SIGNATURE + b"x"])
    got = [r.s for r in df.orderBy("id").select(signature_status(F.col("content")).alias("s")).collect()]
    assert got == ["ok", "ok", "too_small", "bad_signature"]


def test_u32(spark):
    df = frame(spark, [bytes.fromhex("0000000400000001"), bytes.fromhex("FFFFFFFF80000000"), b"\x01\x02\x03"])
    c = F.col("content")
    read = df.orderBy("id").select(*[read_u32(c, at, le) for at in (0, 4) for le in (False, True)])
    assert [tuple(r) for r in read.collect()] == [
        (4, 0x04000000, 1, 0x01000000), (0xFFFFFFFF, 0xFFFFFFFF, 0x80000000, 0x80), (None,) * 4
    ]
    back = spark.range(1).select(write_u32(F.lit(4), True), write_u32(F.lit(0xFFFFFFFE), False)).first()
    assert [bytes(x) for x in back] == [bytes.fromhex("04000000"), bytes.fromhex("FFFFFFFE")]


def test_find_has_null_for_null(spark):
    assert spark.range(1).select(find_bytes(F.lit(None).cast("binary"), b"a")).first()[0] is None
