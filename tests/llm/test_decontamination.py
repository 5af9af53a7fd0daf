import itertools
import random

import brute
import numpy as np
from keytally.llm import decontamination as d
from pyspark.sql import functions as F


def test_filter_loses_no_hash(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63 - 1, 5_000)
    tests = spark.createDataFrame([(int(h),) for h in hashes], "hash bigint")
    packed = d.bloom_filter(tests)
    assert len(d._passes(packed, hashes.view(np.uint64))) == len(hashes)
    others = rng.integers(-(2**63), 2**63 - 1, 50_000).view(np.uint64)
    assert len(d._passes(packed, others)) < 100
    assert len(d._passes(d.bloom_filter(tests.limit(0)), others)) == 0


def _planted(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(5_000)}"
    items = {i: [word() for _ in range(rng.randrange(15, 40))] for i in range(20)}
    docs, want = {}, {}
    for i in range(80):
        text = [word() for _ in range(rng.randrange(0, 200))]
        if i % 2:
            item = i % 20
            said = list(items[item])
            for k in range(3 + i % 3, len(said), 8):  # every eighth word replaced
                said[k] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = said
            want[i] = item
        docs[i] = " ".join(text)
    frame = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t).title()) for i, t in items.items()], "item_id bigint, text string")
    return frame, benchmark, want


def test_substitutions_are_tolerated_and_clean_documents_left_alone(spark):
    docs, benchmark, want = _planted(spark)
    got = d.contamination(docs, benchmark).collect()
    assert len(got) == 80
    assert {r["doc_id"]: r["item_id"] for r in got if r["contaminated"]} == want
    assert {r["doc_id"] for r in d.drop_contaminated(docs, benchmark).collect()} == set(range(80)) - set(want)


def test_whole_items_in_the_given_documents(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r["text"] for r in benchmark.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(brute.holds(r["text"], item) for item in items)}
    got = {r["doc_id"] for r in d.contamination(docs, benchmark).filter("contaminated").collect()}
    assert want and got == want


def test_edges(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame(
        [(1, "one two three four five six seven", "x"), (2, None, "x"), (3, "", "x"), (4, "short one", "x"), (1, "other", "x")],
        "item_id bigint, text string, doc_id string",
    )
    got = {(r["doc_id"], r["contaminated"], r["item_id"]) for r in d.contamination(edge_docs, benchmark).collect()}
    found = {1: 1, 2: 1, None: 1, 9: 4}
    assert got == {(i, i in found, found.get(i)) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, None]}
    kept = d.drop_contaminated(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.count() == 6
    assert d.contamination(no_docs, benchmark).count() == 0
    assert d.contamination(edge_docs, benchmark.filter(F.lit(False))).filter("contaminated").isEmpty()


def _counts(agree, least=10):
    """The most agreeing words of any stretch that the stated rule lets count, by all stretches; 0 if none."""
    most = 0
    for a, b in itertools.combinations(range(len(agree) + 1), 2):
        agreeing = sum(agree[a:b])
        if agreeing >= least and 10 * agreeing >= 7 * (b - a):
            most = max(most, agreeing)
    return most


def test_longest_overlap_equals_the_stated_rule():
    rng = np.random.default_rng(4)
    cases = [rng.random(rng.integers(0, 30)) < rng.choice([0.5, 0.7, 0.8]) for _ in range(300)]
    cases.append([True] * 2 + [False] + [True] * 9 + [False] + [True] * 2)
    for agree in cases:
        item = np.arange(len(agree))
        said = np.concatenate([[-1] * 3, np.where(agree, item, -1)]).astype(np.int64)
        first, end, agreeing = d.longest_overlap(said, item, 3)
        assert agreeing == _counts(list(map(int, agree)), 1)
        assert agreeing == int(np.sum(agree[first - 3 : end - 3])) and 10 * agreeing >= 7 * (end - first)


def test_every_overlap_that_counts_holds_a_seed():
    """The largest sum of 3 and -7 of a stretch without any seed, over all stretches of up to 30 words."""
    width = max(map(len, d.MASKS))
    state = np.arange(1 << width)
    seed = np.zeros(len(state), bool)
    for mask in d.MASKS:
        seed |= (state & int(mask, 2)) == int(mask, 2)
    none = -(10**6)
    best = np.full((len(state), d.LEAST_WORDS + 1), none)  # by last words and number of agreeing ones
    best[0, 0] = 0
    half = len(state) // 2
    for _ in range(30):
        after = np.full_like(best, none)
        for same, gain in ((1, 3), (0, -7)):
            after_state = (2 * state + same) % len(state)
            for n in range(d.LEAST_WORDS + 1):
                value = np.where(seed[after_state] | (best[:, n] == none), none, best[:, n] + gain)
                value = np.maximum(value[:half], value[half:])
                to = after[:, min(n + same, d.LEAST_WORDS)]
                to[after_state[:half]] = np.maximum(to[after_state[:half]], value)
        best = after
        assert best[:, d.LEAST_WORDS].max() < 0


def test_all_placements_of_substitutions_in_the_shortest_items(spark):
    item = [f"w{i}" for i in range(15)]
    placed = [c for n in range(7) for c in itertools.combinations(range(15), n)][::7]
    docs, want = {}, set()
    for k, gone in enumerate(placed):
        agree = [int(i not in gone) for i in range(15)]
        docs[k] = " ".join([f"a{k}", *[w if same else f"x{i}" for i, (w, same) in enumerate(zip(item, agree))], f"b{k}"])
        if _counts(agree):
            want.add(k)
    frame = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"] for r in d.contamination(frame, benchmark).filter("contaminated").collect()}
    assert 0 < len(want) < len(docs) and got == want


def test_clean_rows_of_the_same_id_stay(spark):
    item = " ".join(f"t{i}" for i in range(15))
    rows = [(None, f"leak {item}"), (None, "clean words without an id"), (None, ""), (1, f"{item} leak"), (1, "clean words"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = {(r["doc_id"], r["text"]) for r in d.drop_contaminated(docs, benchmark).collect()}
    assert kept == {row for row in rows if item not in (row[1] or "")}
    marked = d.contamination(docs, benchmark)
    assert marked.count() == len(rows) and marked.filter("contaminated").count() == 2


def test_items_below_a_seed_are_exact_word_runs(spark):
    rng = random.Random(6)
    items = {1: "what is two plus", 2: "Solo", 3: "a b", 4: "b a b", 5: None, 6: "...", 7: "what is two plus", 8: "é ü"}
    texts = [" ".join(rng.choice("ab") if rng.random() < 0.5 else f"x{rng.randrange(9)}" for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += ["so What is, two PLUS two", "what is two minus plus", "what is two", "solos", "a solo", "é-ü", "", None, "w " * 5_000 + "é ü"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(5)
    benchmark = spark.createDataFrame([*items.items()], "item_id bigint, text string")
    want = {}
    for i, text in enumerate(texts):
        said = brute.words(text or "")
        for item, phrase in items.items():
            asked = brute.words(phrase or "")
            places = [k for k in range(len(said) - len(asked) + 1) if said[k : k + len(asked)] == asked] if asked else []
            if places:
                want[i, item] = (places[0], places[0] + len(asked), len(asked))
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["end_word"], r["agreeing"]) for r in d.overlaps(docs, benchmark).collect()}
    assert len(want) > 40 and got == want
    kept = {r["doc_id"] for r in d.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
