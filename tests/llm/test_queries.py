"""Every query of the package: the SQL's rows in DuckDB, or a row per document, conversation or word."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare  # noqa: E402
import pytest  # noqa: E402

from keytally.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", [*queries()])
def test_query(spark, sf_dir, tiny_dir, name):
    if name in oracle_sql():
        assert compare.difference(queries()[name](spark, sf_dir), compare.connect(sf_dir), oracle_sql()[name]) is None
    else:
        rows = queries()[name](spark, tiny_dir).collect()
        if name == "op11_spelling":
            assert rows and len({r["word"] for r in rows}) == len(rows)
            return
        table, id = ("conversations", "conv_id") if name == "op12_conversation_repair" else ("documents", "doc_id")
        given = spark.read.parquet(f"{tiny_dir}/{table}.parquet").select(id)
        given = given.distinct() if id == "conv_id" else given
        assert sorted(r[id] for r in rows) == sorted(r[id] for r in given.collect())


def test_there_is_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
