import random
from collections import Counter

import brute
import pyarrow as pa
from keytally.llm import exact
from pyspark.sql import functions as F


def test_misra_gries_bounds():
    rng = random.Random(1)
    for counters in (1, 5, 40):
        values = [str(min(int(rng.expovariate(0.1)), 300)).encode() for _ in range(5_000)]
        arrays = [pa.array(values[i : i + 700], pa.binary()) for i in range(0, len(values), 700)]
        kept, true = exact.misra_gries(iter(arrays), counters), Counter(values)
        assert len(kept) <= counters
        for value, n in true.items():
            assert n - len(values) / (counters + 1) <= kept.get(value, 0) <= n


def test_heavy_hitters_are_split_off_and_results_agree(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    digests = docs.select("doc_id", exact.digest_of().alias("digest"))
    winners = exact.frequent(digests).collect()
    assert [(w["keep_id"], w["group_size"]) for w in winners] == [(0, 1_000)]
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        own = groups[dict(rows)[row["doc_id"]]]
        assert (row["keep_id"], row["group_size"], row["kept"]) == (min(own), len(own), row["doc_id"] == min(own))


def test_edges(edge_docs, no_docs):
    got = {(r["doc_id"], r["group_size"], r["keep_id"], r["kept"]) for r in exact.exact_groups(edge_docs).collect()}
    assert {(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False)} <= got
    assert {(3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False)} <= got  # NULL and empty are equal
    assert (5, 1, 5, True) in got  # a blank is not empty
    assert exact.exact_groups(no_docs).count() == 0
    kept = exact.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert [r["kept"] for r in kept.filter("doc_id = 1").collect()] == ["mine"]


def test_stage_keeps_the_first_of_each_text(spark, tiny):
    texts = {r["doc_id"]: brute.normal(r["text"]) for r in tiny.collect()}
    first = {}
    for doc_id in sorted(texts):
        first.setdefault(texts[doc_id], doc_id)
    assert sorted(r["doc_id"] for r in exact.drop_copies(tiny).select("doc_id").collect()) == sorted(first.values())


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "x y", "a"), (1, "x y", "b"), (1, "x\ty", "c"), (None, "z", None), (None, "z", None), (2, "z z", None)]
    rows += [(3, "x y", "a"), (None, None, "n"), (None, "", "m")] + [(9, "hot", "h")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string").repartition(4)
    kept = exact.drop_copies(docs.withColumn("tags", F.create_map(F.lit("k"), F.col("kept"))))
    assert kept.columns == ["doc_id", "text", "kept", "tags"]
    got = Counter((r["doc_id"], brute.normal(r["text"])) for r in kept.collect())
    assert got == {(1, "x y"): 1, (None, "z"): 1, (2, "z z"): 1, (None, ""): 1, (9, "hot"): 1}
    again = exact.drop_copies(docs.repartition(2))
    assert {r["kept"] for r in kept.collect()} >= {r["kept"] for r in again.filter("doc_id = 1").collect()}
