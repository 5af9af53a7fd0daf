import pytest
from pyspark.sql import functions as F

from keytally.functions import text as t


def values(spark, expression, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    return [r.v for r in df.orderBy("i").select(expression(F.col("s")).alias("v")).collect()]


def python_offset(text):
    try:
        return int(text)
    except ValueError:
        try:
            return int(text, 16)
        except ValueError:
            return None


OFFSETS = [
    "6253", "0x186D", "0X186d", "ff", "zz", "", " ", "0", "007", "00ff", "-12", "+12", "-0xff", "1_000", "1__0",
    "_1", "1_", "0x", "0x_ff", "0xf_f", "0x__f", " 42 ", "\t0x10\n", "1 2", "0b1", "1e5", "--1", "é", "0xfg",
    "f_f", "a_", "- 1", "123456789012345678", "0xfffffffffffffff",
]


@pytest.mark.parametrize("text", OFFSETS)
def test_parse_offset(spark, text):
    assert values(spark, t.parse_offset, [text]) == [python_offset(text)]


LARGE = [
    "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "1000000000000000000",
    "7fffffffffffffff", "0x1000000000000000", "0x8000000000000000", "-0x8000000000000000", "f" * 16, "-" + "f" * 16,
    "9" * 19, "9" * 60, "e" * 40, "0" * 70 + "12", "0x" + "0" * 70 + "ff", "9_223_372_036_854_775_807", "not", "", None,
]


@pytest.mark.parametrize("text", LARGE)
def test_offsets_fill_64_bits(spark, text):
    number = None if text is None else python_offset(text)
    fits = number is not None and -(2**63) <= number < 2**63
    assert values(spark, t.parse_offset, [text]) == [number if fits else None]
    status = "not_a_number" if number is None else "ok" if fits else "too_large"
    assert values(spark, t.offset_status, [text]) == [status]


def test_hex_text(spark):
    assert values(spark, t.sanitize_hex, ["12 34", "a-b-c", "xyz", "", "0x1f"]) == ["1234", "ab", "", "", "01"]
    got = values(spark, t.hex_bytes, ["05 00:00 00", "", "0G", "abc", "DEADbeef", "12\n", "05\t00\x0b"])
    assert [None if v is None else bytes(v) for v in got] == [b"\x05\0\0\0", b"", None, None, b"\xde\xad\xbe\xef", b"\x12", b"\x05\0"]
    long = "ab" * 50_000
    assert len(values(spark, t.hex_bytes, [long])[0]) == 50_000


def test_job_id(spark):
    job = "0123456789abcdef" * 2
    lines = [f"Job has been submitted with JobID {job}", f"JobID {job[:31]}", "JobID ABC", f"a\nb JobID {job}\nc"]
    assert values(spark, t.extract_job_id, lines) == [job, None, None, job]


def test_path(spark):
    lines = [
        "Savepoint completed. Path: file:/tmp/x/sp-1 more", "Path: file:", "no path here",
        "Path: file:/a Path: file:/b c\nPath: file:/d", "first\n  Path: file:/only\n",
    ]
    assert values(spark, t.extract_path, lines) == ["/tmp/x/sp-1", "", None, "/b", "/only"]


def test_names(spark):
    paths = ["/a/_metadata", "/a/b.sst", "b.sst", "/a/", "/a.sst/c", "/a/b.sst.tmp"]
    assert values(spark, t.base_name, paths) == ["_metadata", "b.sst", "b.sst", "", "c", "b.sst.tmp"]
    assert values(spark, t.has_suffix, paths) == [False, True, True, False, False, False]
    directory = spark.range(1).select(t.has_suffix(F.lit("d.sst"), is_directory=F.lit(True))).first()[0]
    assert directory is False


def test_tuple_lines(spark):
    df = spark.createDataFrame([("lln", 1), ("a,b", 20), ("", 3)], "w string, n bigint")
    lines = [r[0] for r in df.select(t.render_tuple(F.col("w"), F.col("n"))).collect()]
    assert lines == ["(lln,1)", "(a,b,20)", "(,3)"]
    nothing = spark.createDataFrame([(None, None)], "w string, n bigint")
    assert nothing.select(t.render_tuple(F.col("w"), F.col("n"))).first()[0] == "(null,null)"
    back = spark.createDataFrame([(s,) for s in [*lines, "stack trace", "(x,y)"]], "s string")
    assert [tuple(r) for r in back.select(*t.parse_tuple(F.col("s"))).collect()] == [
        ("lln", 1), ("a,b", 20), ("", 3), (None, None), (None, None)
    ]


LINES = {
    "'6162' seq:3, type:1 => 0000000400000001": ("6162", "0000000400000001", "ok"),
    "'61' seq:3 => 00 04 => 05": ("61", "000405", "ok"),
    "6162 => 123": ("6162", "12", "ok"),
    "'6162 seq:1 => 00": ("6162e1", "00", "ok"),
    "'xy' => 00": ("xy", "00", "bad_hex"),
    "'616' => 00": ("616", "00", "bad_hex"),
    "'6162' = 00": (None, None, "no_arrow"),
    "'' => ": ("", "", "ok"),
    "": (None, None, "no_arrow"),
}


def test_dump_lines(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "value string")
    got = {r.value: (r.key_hex, r.value_hex, r.status) for r in t.parse_dump_lines(df).collect()}
    assert got == LINES


def test_dump_lines_quoted_only(spark):
    df = spark.createDataFrame([("6162 =>  00 ",), ("'61' =>  0z ",)], "value string")
    got = [(r.key_hex, r.value_hex, r.status) for r in t.parse_dump_lines(df, quoted_only=True).collect()]
    assert got == [(None, "00", "ok"), ("61", "0z", "bad_hex")]


def test_rendered_dump_line_parses(spark):
    df = spark.createDataFrame([("6162", 7, "00")], "k string, seq int, v string")
    line = df.select(t.render_dump_line(F.col("k"), F.col("seq"), F.col("v")).alias("value"))
    assert line.first().value == "'6162' seq:7, type:1 => 00"
    assert t.parse_dump_lines(line).first().key_hex == "6162"
