import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from keytally.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
sys.setrecursionlimit(20_000)
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(rows):
    """Audit, cost and repaired turns of ``(role, text)`` rows, by all edits in order of cost and initials."""
    marks, seen = [], set()
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        mark = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(mark)

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        full = {"u": "user", "a": "assistant"}
        if inserts < 3:
            for to in set(NEXT[state]) - {"s"}:
                cost, audit, turns = best(i, to, inserts + 1)
                ways.append((cost + 2, "I" + audit, (f"{full[to]}:",) + turns))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, turns = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, turns))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                if role[:1] in NEXT[state]:
                    cost, audit, turns = best(i + 1, NEXT[state][role[:1]], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}",) + turns))
                for to in set(NEXT[state]) - {"s"}:
                    cost, audit, turns = best(i + 1, to, 0)
                    ways.append((cost + more + 2, "R" + audit, (f"{full[to]}:{text}",) + turns))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, turns = best(0, "", 0)
    initials = "".join(role[:1] or " " for role, _ in rows)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    return [marks.count(m) for m in ("blank", "duplicate", "truncated")] + [illegal, cost, audit], "\n".join(turns)


def brute_digest(rows):
    """``{conv_id: result}`` of undamaged rows ``(conv_id, turn, role, text)``."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, text = brute_repair([r[1:] for r in own])
        found[conv] = (gaps, *counts, hashlib.sha256(text.encode()).hexdigest())
    return found


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def digests(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def some_rows(seed, size, convs=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "", " \t", "Why? \n", None, "é!", "Yes."] + [f"t{i}." for i in range(9)]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(25)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]


@pytest.mark.parametrize("block, chunk", [(1, 1), (3, 2), (4096, 64)])
def test_like_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = some_rows(1, 900)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("mine")).repartition(3)
    assert digests(repair.repair_digest(df, block=block)) == brute_digest(rows)


def test_the_last_block_adds_what_is_missing(spark):
    rows = [(1, 0, "system", "Be kind."), (2, 0, "user", "Why?"), (3, 0, "system", ""), (4, 0, "assistant", "So.")]
    found = digests(repair.repair_digest(spark.createDataFrame(rows, SCHEMA)))
    assert {conv: result[5:7] for conv, result in found.items()} == {1: (3, "D"), 2: (2, "KI"), 3: (3, "D"), 4: (2, "IK")}
    assert found == brute_digest(rows)


def test_damaged_tables(spark, tiny_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += some_rows(2, 300)
    got = digests(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)))
    wanted = brute_digest(brute_damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: wanted.get(conv, empty) for conv in {r[0] for r in rows}}


def test_a_conversation_in_many_blocks(spark):
    """One conversation with nearly all rows, numbered in stretches and walked in blocks."""
    rows = [(7, i // 2, r[2], r[3]) for i, r in enumerate(some_rows(3, 700))] + [(8, 0, "user", "A?")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(repair.repair_digest(df, block=16, stretch_rows=50)) == brute_digest(rows)


def test_repaired_turns(spark):
    rows = [(1, 5, "assistant", "Yes."), (1, 6, "assistant", "No."), (1, 7, "tool", "x!"), (1, 9, "assistant", "End.")]
    ordered = repair.rows_in_order(spark.createDataFrame(rows, SCHEMA))
    scripts = repair.edit_scripts(repair.faults(ordered))
    got = [tuple(r) for r in repair.repaired(ordered, scripts).orderBy("row", "ord").select("edit", "turn", "role", "text").collect()]
    text = "\n".join(f"{r[2]}:{r[3]}" for r in got)
    counts, wanted = brute_repair([r[2:] for r in rows])
    assert text == wanted and "".join(r[0] for r in got) == counts[-1].replace("D", "")
    assert all((turn is None) == (edit == "I") for edit, turn, _, _ in got)


def test_walk_is_the_least_of_the_cheapest():
    """Blocks walked with checkpoints, against the vectors of whole runs."""
    rng = random.Random(4)
    for size in (0, 1, 2, 17, 100):
        codes = "".join(chr(65 + rng.randrange(12)) for _ in range(size))
        (audit, state), = repair.walk(codes, repair._END, [0])
        audit += repair.finish(state)
        matrix = repair.block_matrix(codes)
        cost = repair.applied(matrix, list(repair._END))[0]
        weights = {"D": 3, "I": 2, "R": 2, "K": 0}
        kept = [codes[row] for row, edit, _ in repair.edits_of(codes, audit, 0) if edit != "I"]
        assert cost == sum(weights[e] for e in audit) + sum((ord(c) - 65) % 3 == 1 for c in kept)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digest(empty).count() == 0 and repair.repair_damaged(empty).count() == 0
    rows = [(None, None, None, None)] * 3 + [(1, 0, "user", "a " * 300_000 + "."), (1, 1, "assistant", "b.")]
    assert digests(repair.repair_digest(spark.createDataFrame(rows, SCHEMA))) == brute_digest(rows)
