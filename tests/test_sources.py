import itertools
import string

import pytest
from pyspark.sql import functions as F

from keytally.sources import words
from keytally.sources.files import binary_files, dump_lines
from keytally.operators.ranking import largest_state_file
from keytally import session


@pytest.mark.parametrize("length", [1, 2, 3])
def test_vocabulary(spark, length):
    got = [r.word for r in words.vocabulary(spark, length).orderBy("id").collect()]
    assert got == ["".join(c) for c in itertools.product(string.ascii_lowercase, repeat=length)]


def test_four_letters(spark):
    vocabulary = words.vocabulary(spark, 4)
    ends = vocabulary.agg(F.count("*"), F.min("word"), F.max("word")).first()
    assert tuple(ends) == (456_976, "aaaa", "zzzz")
    assert vocabulary.filter("word < 'aaab' OR word > 'zzzy'").count() == 2


def test_stats(spark):
    draws = words.draw_words(spark.range(20_000), "id", seed=42)
    assert tuple(words.vocabulary_stats(draws).first()) == (17_576, 20_000, 20_000 / 17_576, "1.1")


def test_draws_are_uniform_and_seeded(spark):
    rows = spark.range(20_000)
    first = words.draw_words(rows, "id", seed=42)
    again = words.draw_words(rows.repartition(7), "id", seed=42)
    other = words.draw_words(rows, "id", seed=43)
    assert first.exceptAll(again).count() == 0
    assert 11_600 < first.select("word").distinct().count() < 12_200
    assert first.exceptAll(other).count() > 19_000
    per_letter = first.groupBy(F.substring("word", 1, 1)).count().collect()
    assert len(per_letter) == 26 and all(600 < r["count"] < 950 for r in per_letter)


def test_draw_from_a_vocabulary(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ["x", "yy", "z", "é", "x"]], "word string")
    got = words.draw_from(spark.range(4000), "id", words.bucketed_words(vocabulary), seed=1)
    counts = {r.word: r["count"] for r in got.groupBy("word").count().collect()}
    assert set(counts) == {"x", "yy", "z", "é"} and sum(counts.values()) == 4000
    assert all(850 < c < 1150 for c in counts.values())


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        words.draw_from(spark.range(1), "id", words.bucketed_words(spark.createDataFrame([], "word string")), seed=1)


def test_largest_state_file(spark):
    files = spark.createDataFrame(
        [("/s/_metadata", 99), ("/s/b", 5), ("/s/a", 5), ("/s/c", 4), ("/t/x", 0), ("/u/_metadata", 1), ("/v/y", 1)],
        "path string, length bigint",
    )
    assert {tuple(r) for r in largest_state_file(files).collect()} == {("/s", "/s/a", 5), ("/v", "/v/y", 1)}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.sst").write_bytes(b"\x00\x01")
    (tmp_path / "b.txt").write_text("one\n\n  \t\ntwo \n")
    got = binary_files(spark, str(tmp_path), "*.sst").collect()
    assert [(r.path.endswith("/sub/a.sst"), bytes(r.content)) for r in got] == [(True, b"\x00\x01")]
    assert [r.value for r in dump_lines(spark, str(tmp_path / "b.txt")).collect()] == ["one", "two "]


def test_names_are_read_without_contents(spark, tmp_path):
    (tmp_path / "a.sst").write_bytes(b"abc")
    names = binary_files(spark, str(tmp_path)).select("path", "length")
    assert "content" not in names._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_work_dir_is_in_the_shared_folder():
    shared = _Session(**{"spark.checkpoint.dir": "hdfs://x/shared/", "spark.master": "yarn"})
    first, second = session.work_dir(shared, "a"), session.work_dir(shared, "a")
    assert first.startswith("hdfs://x/shared/keytally/a-") and first != second
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(_Session(**{"spark.master": "yarn"}), "a")
    assert session.work_dir(_Session(**{"spark.master": "local[2]"}), "a")
