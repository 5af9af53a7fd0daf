import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keytally.llm import spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """By what each word is without one letter, at the same place or as a whole."""
    where = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            where[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in where.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return near


def brute_groups(counts):
    near, forms = brute_near(counts.keys()), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
    found = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        found.add((w, forms[w], root, n, len(near[w]), counts.get(forms[w])))
    return found


def random_counts(seed, size):
    rng = random.Random(seed)
    counts = {}
    for _ in range(size):
        w = "".join(rng.choice("abeé") for _ in range(rng.randint(6, 8)))
        counts[w] = rng.choice([5, 6, 30, 200, 1000, 1000, 6000])
        edits = list(w)
        edits[rng.randrange(len(w))] = rng.choice(["", "x", "ÿ", "ab"])
        if len(edits := "".join(edits)) >= 6:
            counts[edits] = rng.choice([5, 25, 130])
    return counts


@pytest.mark.parametrize("bucket", [1, 4, 200])
def test_groups_like_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "LONG", 7 if bucket == 4 else 64)
    counts = random_counts(1, 700) | {"x" * 5_000: 7, "x" * 5_001: 50, "abcdef": 5, "fedcba": 500}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = [tuple(r) for r in spelling.spelling_groups(df, bucket=bucket).collect()]
    assert len(got) == len(counts) and set(got) == brute_groups(counts)


def test_whole_documents(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in tiny.select("doc_id", "text").collect()]
    got = [tuple(r) for r in spelling.spelling_variants(tiny.withColumn("word", F.lit(1))).collect()]
    wanted = brute_groups(brute_words(rows))
    assert len(got) == len(wanted) and set(got) == wanted and any(r[1] for r in got)


def test_words_of_odd_texts(spark, edge_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    texts = ["Straße ÀÉÎÕÜ×÷ÿ STRAßE Größer", None, "", "Abcdef1ghijkl_mnopqr", "a" * 200_000 + " zzzzzz", "Ābcdefgh İstanbul"]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    counted = spelling.vocabulary(spelling.spoilt(spelling.word_runs(df)))
    assert {r["word"]: r["n"] for r in counted.collect()} == brute_words(rows)
    got = {tuple(r) for r in spelling.spelling_variants(edge_docs).collect()}
    assert got == brute_groups(brute_words([(r["doc_id"], r["text"]) for r in edge_docs.collect()]))


def test_words_one_edit_apart_share_a_signature(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(1_500):
        w = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(6, 14)))
        i, c = rng.randrange(len(w)), rng.choice(ALPHABET)
        pairs.append((w, rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])))
    words = sorted({w for p in pairs for w in p})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    keys = defaultdict(set)
    for r in spelling.signatures(df).collect():
        keys[r["word"]].add(r["key"])
    assert all(keys[a] & keys[b] for a, b in pairs) and {len(k) for k in keys.values()} == {27}
    found = {(r["word"], r["other"]) for r in spelling.near_pairs(df, bucket=3).collect()}
    assert found >= {(min(a, b), max(a, b)) for a, b in pairs if a != b}


def test_a_bucket_with_a_third_of_all_words_makes_no_pairs(spark):
    """Anagrams share all signatures; only those one edit apart are compared."""
    rng = random.Random(6)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3_000)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling.near_pairs(df).count() == 0
    many = spelling.signatures(df).select("word", "key", F.explode(spelling.remainders("word")).alias("rest"))
    assert many.groupBy("key", "rest").count().agg(F.max("count")).first()[0] <= 10
