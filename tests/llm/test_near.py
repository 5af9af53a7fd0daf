import random

import brute
import numpy as np
import pytest
from keytally.llm import near
from keytally.llm.components import components
from keytally.llm.words import mix


def _agreement(a: dict, b: dict, t: int = 200) -> float:
    elements = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()], np.float64)
    row = np.repeat([0, 1], [len(a), len(b)])
    ids = near.dart_minhash(mix(elements), weights, row, 2, t)
    assert (ids != 0).all()
    return float((ids[0] == ids[1]).mean())


@pytest.mark.parametrize("size, shared, weighted", [(300, 0.8, False), (30, 0.5, False), (40, 0.6, True), (3, 1.0, True)])
def test_signatures_agree_as_weighted_jaccard(size, shared, weighted):
    rng = random.Random(size)
    gaps = []
    for _ in range(30):
        a = {rng.getrandbits(60): rng.random() * 3 + 0.01 if weighted else 1.0 for _ in range(size)}
        b = {x if rng.random() < shared else rng.getrandbits(60): w for x, w in a.items()}
        both = sum(min(w, b.get(x, 0)) for x, w in a.items())
        gaps.append(_agreement(a, b) - both / (sum(a.values()) + sum(b.values()) - both))
    assert abs(np.mean(gaps)) < 0.02


def test_empty_rows_have_no_darts():
    ids = near.dart_minhash(mix(np.arange(1, 4, dtype=np.uint64)), np.ones(3), np.array([1, 1, 1]), 3, 50)
    assert (ids[[0, 2]] == 0).all() and (ids[1] != 0).all()
    assert near.dart_minhash(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), 2, 8).shape == (2, 8)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    shuffled = [(b, a) if (a * 7) % 3 else (a, b) for a, b in chain + star + [(7, 7), (200, 7)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(shuffled, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _family() -> dict[int, str]:
    """A passage that many texts share, a family of edited copies, exact copies, and single texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4_000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(80)]
    docs: dict[int, str] = {}
    for i in range(40):
        docs[i] = " ".join([word() for _ in range(50)] + passage)
    for i in range(40, 90):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        docs[i] = " ".join(copy)
    for i in range(90, 100):
        docs[i] = docs[50].upper() if i % 2 else docs[41].replace(" ", ", ")
    for i in range(100, 130):
        docs[i] = " ".join(word() for _ in range(rng.randrange(1, 60)))
    return docs


@pytest.mark.parametrize("few, most", [(45, 10_000_000), (0, 10_000_000), (0, 0)])
def test_classes_equal_brute_force(spark, few, most):
    docs = _family()
    want = brute.near_classes(docs)
    frame = spark.createDataFrame([*docs.items()], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in near.near_groups(frame, few_pairs=few, most_pairs=most).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == want
    sizes = {d: sum(c == want[d] for c in want.values()) for d in want}
    assert all((r["class_size"], r["kept"]) == (sizes[d], want[d] == d) for d, r in got.items())


def _refrains() -> dict[int, str]:
    """Texts with a refrain of up to forty rounds: near copies by their sets, far apart by their counts, or the reverse."""
    rng = random.Random(11)
    docs: dict[int, str] = {}
    for family in range(12):
        refrain = [f"r{family}x{i}" for i in range(rng.randrange(3, 9))]
        verse = [f"v{family}x{i}" for i in range(rng.randrange(20, 60))]
        for _ in range(8):
            own = list(verse)
            own[rng.randrange(len(own))] = f"o{rng.randrange(10)}"
            docs[len(docs)] = " ".join(own + refrain * rng.choice([1, 2, 10, 11, 40]))
    return docs


@pytest.mark.parametrize("few, most", [(45, 10_000_000), (0, 10_000_000), (0, 0)])
def test_weighted_classes_equal_brute_force(spark, few, most):
    docs = _refrains()
    want = brute.near_classes(docs, sets_of=brute.counted_shingles)
    assert want != brute.near_classes(docs)
    frame = spark.createDataFrame([*docs.items()], "doc_id bigint, text string").repartition(4)
    got = near.near_groups(frame, few_pairs=few, most_pairs=most, counted=True).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_blocks_of_few_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 200)
    docs = _family()
    frame = spark.createDataFrame([*docs.items()], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(frame, few_pairs=0).collect()}
    assert got == brute.near_classes(docs)


def test_edges(edge_docs, no_docs):
    got = [(r["doc_id"] or 0, r["class_id"], r["kept"]) for r in near.near_groups(edge_docs).collect()]
    assert len(got) == edge_docs.count()
    by_id = {}
    for doc_id, class_id, kept in got:
        by_id.setdefault(doc_id, set()).add((class_id, kept))
    assert by_id == {
        0: {(None, True)}, 1: {(1, True)}, 2: {(1, False)}, 3: {(3, True)}, 4: {(4, True)}, 5: {(5, True)},
        6: {(6, True)}, 7: {(6, False)}, 8: {(8, True)}, 9: {(9, True)},
    }
    assert near.near_groups(no_docs).count() == 0
    kept = near.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("far", [7, 2**63 - 1, -(2**63)])
def test_a_text_that_shares_the_id_of_a_near_copy_stays(spark, far):
    base = [f"w{i}" for i in range(60)]
    copy, other = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, " ".join(base)), (2, copy), (2, other), (2, other), (2, None), (3, None), (3, "one"), (far, "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in near.drop_near_copies(docs).collect()), key=str)
    # Where no number is free above the ids, the copy may be the one of the class that stays.
    assert got in [sorted((row for row in rows if row != gone), key=str) for gone in (rows[1], rows[0])]
    assert far != 7 or (2, copy) not in got
