import random
from fractions import Fraction

import pytest
from keytally.llm import mixing, tables


def _slots(blocks, weights):
    found = {}
    for source, stretches in enumerate(mixing.periods(blocks, weights)):
        for k in range(blocks[source]):
            s = [x for x in stretches if x["from_block"] <= k][-1]
            turn, at = divmod(k - s["from_block"], len(s["slots"]))
            found[s["base"] + turn * s["total"] + s["slots"][at]] = source
    return found


def test_less_than_one_block_from_the_target_in_every_prefix():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 8)
        weights, blocks = [rng.randrange(1, 30) for _ in range(n)], [rng.randrange(0, 150) for _ in range(n)]
        slots = _slots(blocks, weights)
        assert sorted(slots) == list(range(sum(blocks)))
        starts = {s["base"] for stretches in mixing.periods(blocks, weights) for s in stretches}
        left = list(blocks)
        for t in range(sum(blocks)):
            if t in starts:
                begin, had = t, list(left)
                total = sum(weights[s] for s in range(n) if had[s])
            left[slots[t]] -= 1
            for s in range(n):
                if had[s]:
                    assert abs(had[s] - left[s] - Fraction((t + 1 - begin) * weights[s], total)) < 1


def test_mix_equals_the_schedule(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "d"]), f"t{i}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(6)
    weights = {"a": 2, "b": 3, "c": 1, None: 2}
    got = mixing.mix(docs, weights, block_rows=7, cell_rows=50).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2_000))
    pools = ["a", "b", "c", None]
    blocks = [-(-sum(r["mix_pool"] == p for r in got) // 7) for p in pools]
    want = {slot: pools[s] for slot, s in _slots(blocks, [2, 3, 1, 2]).items()}
    assert {(r["mix_slot"], r["mix_pool"]) for r in got} == set(want.items())
    for slot in want:
        at = sorted(r["mix_at"] for r in got if r["mix_slot"] == slot)
        assert at == list(range(len(at))) and len(at) <= 7
    for r in got:
        assert r["mix_pool"] == (r["source"] if r["source"] in ("a", "b", "c") else None)
    again = mixing.mix(docs.repartition(3), weights, block_rows=7, cell_rows=50).collect()
    assert {(r["doc_id"], r["mix_slot"], r["mix_at"]) for r in again} == {(r["doc_id"], r["mix_slot"], r["mix_at"]) for r in got}


def _zipf(n, rng):
    sizes = [max(1, int(3_000 / (k + 1))) for k in range(n)]
    rng.shuffle(sizes)
    return sizes


@pytest.mark.parametrize("n", [250, 2_000])
def test_every_one_of_many_sources_is_within_a_block(n):
    """Prefixes of whole slots, each stretch from its begin, by going through all slots."""
    rng = random.Random(n)
    blocks = _zipf(n, rng)
    weights = [max(1, round(b**0.5)) for b in blocks]
    found = mixing.periods(blocks, weights)
    slots = _slots(blocks, weights)
    assert sorted(slots) == list(range(sum(blocks)))
    starts = sorted({s["base"] for stretches in found for s in stretches}) + [sum(blocks)]
    left = list(blocks)
    for begin, end in zip(starts, starts[1:]):
        having = [s for s in range(n) if left[s]]
        total = sum(weights[s] for s in having)
        got = dict.fromkeys(having, 0)
        for t in range(begin, end):
            # Only the chosen source can be ahead, and it is furthest behind just before.
            s = slots[t]
            assert -total < got[s] * total - (t - begin) * weights[s] < total
            got[s] += 1
            assert -total < got[s] * total - (t + 1 - begin) * weights[s] < total
        for s in having:
            assert -total < got[s] * total - (end - begin) * weights[s] < total
            left[s] -= got[s]


def test_all_sources_are_scheduled(spark):
    rows = [(i, f"s{i % 250}" if i < 1_500 else "hot") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    weights = mixing.target_weights(docs)
    assert set(weights) == {None, "hot", *(f"s{i}" for i in range(250))}
    got = mixing.mix(docs, weights, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3_000))
    assert all(r["mix_pool"] == r["source"] for r in got)
    slots = {(r["mix_slot"], r["mix_pool"]) for r in got}
    assert len(slots) == len({slot for slot, _ in slots}) == 250 * 3 + 750
    blocks = {(r["mix_pool"], r["mix_block"]) for r in got}
    assert blocks == {(f"s{i}", k) for i in range(250) for k in range(3)} | {("hot", k) for k in range(750)}


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "a", f"t{i}") for i in range(2_000)], "doc_id bigint, source string, text string")
    hashes = tables.row_hash(docs, 1).alias("h")
    assert docs.select(hashes).distinct().count() == 2_000
    got = mixing.mix(docs, {"a": 1}, block_rows=10, cell_rows=100).collect()
    assert {(r["mix_slot"], r["mix_at"]) for r in got} == {divmod(i, 10) for i in range(2_000)}


def test_edges(edge_docs, no_docs):
    weights = mixing.target_weights(edge_docs)
    assert set(weights) == {"a", "b", "c", None} and all(w >= 1 for w in weights.values())
    mixed = mixing.mix(edge_docs.withColumnRenamed("kept", "mix_slot"), weights, block_rows=2)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "_0", "score", "mix_pool", "mix_block", "mix_slot", "mix_at"]
    rows = mixed.collect()
    assert len(rows) == edge_docs.count()
    assert len({(r["mix_slot"], r["mix_at"]) for r in rows}) == len(rows)
    assert mixing.mix(no_docs, mixing.target_weights(no_docs)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(no_docs, {"a": 0})
