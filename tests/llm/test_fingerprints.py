import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keytally.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string"


def brute_edits(rows):
    """``{(doc_id, text): (edited text, next text)}`` of rows with distinct ids."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = {}
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        found[doc] = text[: len(text) - half] + after[:half], after
    return found


def sketch(text, fraction=fp.FRACTION):
    (found,) = fp.sketch_texts(pa.array([text], pa.string()), fraction)
    return found


def check(spark, rows, **given):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r["doc_id"]: r for r in fp.compare_with_next(df.repartition(3), **given).collect()}
    wanted = brute_edits(rows)
    assert got.keys() == wanted.keys()
    texts = {doc: text or "" for doc, text in rows}
    for doc, (edited, after) in wanted.items():
        r, own = got[doc], sketch(texts[doc])
        assert r["n_chars"] == len(texts[doc])
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.spelled(own) and r["edited_fingerprint"] == fp.spelled(sketch(edited))
        assert (r["near_edited"], r["jaccard_edited"]) == fp.likeness(own, sketch(edited))
        assert (r["near_next"], r["jaccard_next"]) == fp.likeness(own, sketch(after))


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_against_plain_loops(spark, tiny, monkeypatch, most):
    monkeypatch.setattr(fp, "MOST_PARTS", most)
    rows = [(r["doc_id"], r["text"]) for r in tiny.select("doc_id", "text").collect()]
    rows += [(None, "last of all, without an id: é ü"), (-5, None), (-(1 << 63), ""), ((1 << 63) - 1, "x " * 200_000), (10**6, "!!!")]
    check(spark, rows)


def test_one_row_and_no_rows(spark):
    check(spark, [(3, "only one text here, and it is its own next one")])
    assert fp.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_rows(spark):
    rows = [(1, "a b c d e f")] * 3 + [(1, "g h i j k l"), (None, "m n"), (None, None), (None, "m n")]
    got = fp.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    same = [r for r in got if r["n_chars"] == 11 and r["near_next"] == 1.0]
    assert len(same) >= 2 and all(r["near_edited"] == 1.0 for r in same if r["edited_sha256"] == hashlib.sha256(b"a b c d e f").hexdigest())
    assert got == fp.compare_with_next(spark.createDataFrame(rows[::-1], SCHEMA)).collect() or len(got) == len(rows)


def test_edge_documents(spark, edge_docs):
    got = fp.compare_with_next(edge_docs).collect()
    assert len(got) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_every_hash_below_the_fraction_is_kept():
    text = " ".join(f"w{i * i % 977}" for i in range(3_000))
    all_hashes = sketch(text, 1.0)
    assert len(all_hashes) == len(brute.shingles(text))
    kept = sketch(text)
    assert np.array_equal(kept, all_hashes[all_hashes < np.uint64(fp.limit_of(fp.FRACTION))])
    assert abs(len(kept) / len(all_hashes) - fp.FRACTION) < 0.05
    assert len(sketch("one")) == 1 and len(sketch("... !")) == 0 and len(sketch(None)) == 0
    assert np.array_equal(fp.read_sketch(fp.spelled(kept)), kept)


def test_a_small_part_of_a_large_text_is_estimated(spark):
    large = [f"w{i * 7919 % 10_007}" for i in range(20_000)]
    small = large[500:900] + [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(large)), (2, " ".join(small)), (3, None)]
    s = fp.sketches(spark.createDataFrame(rows, SCHEMA))
    a, b = s.filter("doc_id = 2").withColumnRenamed("sketch", "part"), s.filter("doc_id = 1").select(F.col("sketch").alias("whole"))
    share = a.join(b).select(fp.containment("part", "whole")).first()[0]
    assert abs(share - 0.5) < 0.1
    got = {r["doc_id"]: r["containment"] for r in fp.contained_in(s, fp.merged(s.filter("doc_id = 1").withColumn("g", F.lit(1)), "g")).collect()}
    assert got.keys() == {1, 2} and got[1] == 1.0 and got[2] == share


def test_merged_sketches_are_those_of_the_merged_texts(spark, tiny):
    docs = tiny.limit(60).withColumn("g", F.col("doc_id") % 3)
    s = fp.sketches(docs).withColumn("g", F.col("doc_id") % 3)
    merged = fp.merged(s, "g").groupBy("g").agg(F.sort_array(F.collect_list("hash")).alias("h"))
    got = {r["g"]: set(r["h"]) for r in merged.collect()}
    for g in got:
        every = [sketch(r["text"], 1.0) for r in docs.filter(F.col("g") == g).collect()]
        union = np.unique(np.concatenate(every))
        wanted = union[(union < np.uint64(fp.limit_of(fp.FRACTION)))]
        assert got[g] == set(wanted.view(np.int64).tolist()) | {int(union.min().astype(np.uint64).view(np.int64))}
