import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _0 int, score string"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs everywhere, empty and very long texts, repeated rows, and columns whose names the operators use."""
    rows = [
        (1, "one  two\tthree four five six seven", "en", "a", 5, "mine", 1, "s"),
        (2, "one two three four five six seven", "en", "a", None, None, None, None),
        (2, "one two three four five six seven", "en", "a", None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 2, ""),
        (5, " \n", "en", "b", 2, None, 3, None),
        (None, "one two three four five six seven", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (6, LONG, "de", "b", len(LONG), "x", 4, "y"),
        (7, LONG + " more", "de", "b", None, "x", 4, "y"),
        (8, "12345 !!! ???", "fr", None, None, None, None, None),
        (9, "short one", "fr", "c", None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tiny_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny(spark, tiny_dir):
    return spark.read.parquet(f"{tiny_dir}/documents.parquet")
