"""Conversation structure repair by square-root checkpointed dynamic programming.

A repaired conversation's roles are nothing, or an optional system turn and then
user and assistant in turn. Rows are kept, reroled or deleted and empty turns
inserted at the least cost; among the cheapest edits the ASCII-least string of
their initials is taken. Backwards, the cost from each of four states to the end
is a vector; forwards, an edit is tight if its cost and the vector behind it
make up the vector before it.

Vectors are kept at checkpoints only, on two levels. A conversation is cut into
blocks of ``BLOCK`` rows. Each block alone gives the min-plus matrix from its end
to its start, these are applied backwards over a conversation's blocks, and what
is kept is the vector at the end of each block. Inside a block vectors are kept
at every square root of its rows and computed again, one stretch at a time, while
walking forward. A block is walked from each state it may be entered in; which one
it is, is found by going over the blocks once more. So no task holds the rows of
a conversation, and a conversation with a third of all rows is worked on by as
many tasks as it has blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from keytally.llm.tables import stored
from keytally.operators.counting import STRETCH_ROWS, running_count

BLOCK = 4096
#: Repaired rows whose text is put together before it goes to the task that hashes the conversation.
CHUNK = 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"

# A row's code is a letter: its role's initial (s, u, a or another) times three
# plus what is wrong with it. States: nothing yet, after system, user, assistant.
_FINE, _TRUNCATED, _GONE = 0, 1, 2
_NEXT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
_NEW = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_FIRST_CODE = ord("A")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_FAR = 1 << 40
_END = (0, 2 * INSERT, INSERT, 0)


def _kind(code: str) -> int:
    return (ord(code) - _FIRST_CODE) // 3


def _before(code: str, after: tuple) -> tuple:
    """The vector before a row, from the vector after it."""
    kind, fault = divmod(ord(code) - _FIRST_CODE, 3)
    cost = [DELETE + v for v in after]
    if fault != _GONE:
        for state in range(4):
            ways = [REROLE + after[_NEW[state]]]
            if state in _NEXT[kind]:
                ways.append(KEEP + after[_NEXT[kind][state]])
            cost[state] = min(cost[state], CUT_OFF * (fault == _TRUNCATED) + min(ways))
    user, assistant = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, assistant


@lru_cache(1 << 16)
def _step(code: str, after: tuple) -> tuple[tuple, int]:
    """``_before`` of a vector whose least is 0, as such a vector and what was taken off."""
    before = _before(code, after)
    least = min(before)
    return tuple(min(v - least, _FAR) for v in before), least


@lru_cache(1 << 16)
def _move(code: str, after: tuple, state: int) -> tuple[str, int]:
    """The initials of the least tight edits up to and with a row, and the state behind it."""
    kind, fault = divmod(ord(code) - _FIRST_CODE, 3)
    before = _before(code, after)
    more = CUT_OFF * (fault == _TRUNCATED)
    letters = ""
    while True:
        if before[state] == DELETE + after[state]:
            return letters + "D", state
        if before[state] == INSERT + before[_NEW[state]]:
            letters, state = letters + "I", _NEW[state]
            continue
        if state in _NEXT[kind] and before[state] == KEEP + more + after[_NEXT[kind][state]]:
            return letters + "K", _NEXT[kind][state]
        return letters + "R", _NEW[state]


def _scaled(vector: list[int] | tuple) -> tuple[tuple, int]:
    least = min(vector)
    return tuple(min(v - least, _FAR) for v in vector), least


def block_matrix(codes: str) -> list[int]:
    """``m[4 * i + k]``: the least cost from state i before the block to state k after its last row."""
    matrix = [0] * 16
    for k in range(4):
        vector, total = tuple(0 if i == k else _FAR for i in range(4)), 0
        for code in reversed(codes):
            vector, less = _step(code, vector)
            total += less
        for i in range(4):
            matrix[4 * i + k] = min(vector[i] + total, _FAR)
    return matrix


def applied(matrix: list[int], after: list[int]) -> list[int]:
    return [min(matrix[4 * i + k] + after[k] for k in range(4)) for i in range(4)]


def walk(codes: str, end: list[int] | tuple, states: list[int]) -> list[tuple[str, int]]:
    """The audit of a block and the state behind it, for each state it may be entered in.

    Vectors are kept at about sqrt(n) checkpoints and computed again between two
    of them; a block of n rows so holds some 2 sqrt(n) vectors at a time.
    """
    n = len(codes)
    span = isqrt(n) + 1
    vector, _ = _scaled(end)
    kept = {n: vector}
    for i in range(n - 1, -1, -1):
        vector, _ = _step(codes[i], vector)
        if i % span == 0:
            kept[i] = vector
    letters: list[list[str]] = [[] for _ in states]
    states = list(states)
    for low in range(0, n, span):
        high = min(low + span, n)
        vectors = [kept[high]]
        for i in range(high - 1, low, -1):
            vectors.append(_step(codes[i], vectors[-1])[0])
        for i in range(low, high):
            after = vectors[high - 1 - i]
            for way, state in enumerate(states):
                more, states[way] = _move(codes[i], after, state)
                letters[way].append(more)
    return [("".join(parts), state) for parts, state in zip(letters, states)]


def finish(state: int) -> str:
    """The inserts at the very end."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def edits_of(codes: str, audit: str, state: int) -> Iterator[tuple[int, str, str | None]]:
    """``(row, edit, new role)`` of each edit but deletions; an insert comes before its row."""
    row = 0
    for edit in audit:
        if edit == "D":
            row += 1
        elif edit == "K":
            yield row, edit, None
            state = _NEXT[_kind(codes[row])][state]
            row += 1
        else:
            state = _NEW[state]
            yield row, edit, _ROLE[state]
            row += edit == "R"


def _illegal(codes: str) -> int:
    kinds = [_kind(c) for c in codes]
    return sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:]))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch["codes"].to_pylist()
        yield batch.append_column("matrix", pa.array([block_matrix(c) for c in codes], pa.list_(pa.int64()))).append_column(
            "illegal", pa.array([_illegal(c) for c in codes], pa.int64())
        )


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by conversation, the last one first."""
    of, vector = (), []
    for batch in batches:
        ends, costs, last = [], [], []
        for conv, matrix in zip(batch["conv"].to_pylist(), batch["matrix"].to_pylist()):
            last.append((conv,) != of)
            if last[-1]:
                of, vector = (conv,), list(_END)
            ends.append(vector)
            vector = applied(matrix, vector)
            costs.append(vector[0])
        kept = batch.select(["conv", "block", "first", "codes", "illegal"])
        for name, values, kind in (("behind", ends, pa.list_(pa.int64())), ("cost", costs, pa.int64()), ("last", last, pa.bool_())):
            kept = kept.append_column(name, pa.array(values, kind))
        yield kept


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first block is entered in one state, all others are walked from all four."""
    for batch in batches:
        audits, exits = [], []
        for block, codes, end in zip(*(batch[c].to_pylist() for c in ("block", "codes", "behind"))):
            ways = walk(codes, end, [0] if block == 0 else [0, 1, 2, 3])
            audits.append([audit for audit, _ in ways])
            exits.append([state for _, state in ways])
        kept = batch.drop_columns(["behind"])
        yield kept.append_column("audits", pa.array(audits, pa.list_(pa.string()))).append_column(
            "exits", pa.array(exits, pa.list_(pa.int64()))
        )


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by conversation, the first one first."""
    of, state, before = (), 0, None
    for batch in batches:
        entered, chosen, illegal = [], [], []
        columns = (batch[c].to_pylist() for c in ("conv", "codes", "illegal", "last", "audits", "exits"))
        for conv, codes, inside, last, audits, exits in zip(*columns):
            if (conv,) != of:
                of, state, before = (conv,), 0, None
            entered.append(state)
            illegal.append(inside + (before is not None and (before, _kind(codes[0])) not in _LEGAL))
            audit, state, before = audits[state], exits[state], _kind(codes[-1])
            chosen.append(audit + finish(state) if last else audit)
        kept = batch.select(["conv", "block", "first", "codes", "cost"])
        for name, values, kind in (("illegal", illegal, pa.int64()), ("entered", entered, pa.int64()), ("audit", chosen, pa.string())):
            kept = kept.append_column(name, pa.array(values, kind))
        yield kept


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, parts = batch["conv"], ([], [], [], [], [])
        for at, (first, codes, audit, state) in enumerate(zip(*(batch[c].to_pylist() for c in ("first", "codes", "audit", "entered")))):
            for order, (row, edit, role) in enumerate(edits_of(codes, audit, state)):
                for part, value in zip(parts, (at, first + row, order, edit, role)):
                    part.append(value)
        places = pa.array(parts[0], pa.int64())
        yield pa.record_batch(
            [convs.take(places), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int64()), pa.array(parts[3], pa.string()), pa.array(parts[4], pa.string())],
            ["conv", "row", "ord", "edit", "role"],
        )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come by conversation in order; only the running hash of one conversation is held."""
    of, running, kind = (), None, None

    def result() -> pa.RecordBatch:
        return pa.record_batch([pa.array([of[0]], kind), pa.array([running.hexdigest()])], ["conv", "sha256"])

    for batch in batches:
        kind = batch["conv"].type
        for conv, lines in zip(batch["conv"].to_pylist(), batch["lines"]):
            if (conv,) != of:
                if running is not None:
                    yield result()
                of, running = (conv,), hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(lines.as_buffer())
    if running is not None:
        yield result()


def rows_in_order(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copy: str | None = None, stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """A stored table ``(conv, row, turn, role, text)`` with rows from 0 by turn, NULL first, then role and text.

    NULL roles and texts are one space. ``copy`` names a number that tells rows
    apart that are alike otherwise; such rows may follow each other in any order.
    """
    plain = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        F.lit(0).alias("copy") if copy is None else F.col(copy).alias("copy"),
    )
    numbered = running_count(plain, "conv", ["turn", "role", "text", "copy"], stretch_rows=stretch_rows)
    return stored(numbered.select("conv", (F.col("n") - 1).alias("row"), "turn", "role", "text"), "turns")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, row, fault, code)`` of ``rows_in_order``: blank, duplicate, truncated or NULL, whichever comes first.

    Blank rows have nothing but blanks; a duplicate has the role and text of an
    earlier row; a truncated row does not end in ``.``, ``!`` or ``?`` before blanks.
    """
    said = F.rtrim(F.col("text"), F.lit(_BLANKS))
    narrow = rows.select("conv", "row", "role", said.alias("said"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")).select(
        "conv",
        "row",
        "role",
        "digest",
        (F.col("said") == "").alias("blank"),
        (~F.right("said", F.lit(1)).isin(*_ENDS)).alias("truncated"),
    )
    # The first of equal rows is joined by its own number, so a text that all rows have is no hot key.
    first = narrow.groupBy("conv", "role", "digest").agg(F.min("row").alias("first_row")).select(F.col("conv").alias("first_conv"), "first_row")
    marked = narrow.join(first, _same("conv", "first_conv") & (F.col("row") == F.col("first_row")), "left")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first_row").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    )
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    wrong = F.when(F.col("fault").isNull(), _FINE).when(F.col("fault") == "truncated", _TRUNCATED).otherwise(_GONE)
    code = F.char((kind * 3 + wrong + _FIRST_CODE).cast("bigint"))
    return marked.withColumn("fault", fault).select("conv", "row", "fault", code.alias("code"))


def _in_one_task(blocks: DataFrame, *order: Column) -> DataFrame:
    """The blocks of a conversation one after another; a block stands for ``BLOCK`` rows."""
    return blocks.repartition("conv").sortWithinPartitions("conv", *order)


def _spread(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("conv", "block")


def edit_scripts(coded: DataFrame, block: int = BLOCK) -> DataFrame:
    """A stored table ``(conv, block, first, codes, cost, illegal, entered, audit)`` from the result of ``faults``.

    ``first`` is the block's first row, ``cost`` is that from the block's start to the conversation's end, ``entered``
    the state in which the cheapest edits enter it.
    """
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "code"))), lambda x: x["code"]), "")
    blocks = coded.groupBy("conv", F.expr(f"row div {block}").alias("block")).agg(F.min("row").alias("first"), spelled.alias("codes"))
    conv = f"conv {_type_of(blocks, 'conv').simpleString()}, block bigint, first bigint, codes string"
    measured = blocks.mapInArrow(_matrices, f"{conv}, matrix array<bigint>, illegal bigint")
    ends = _in_one_task(measured, F.col("block").desc()).mapInArrow(
        _backwards, f"{conv}, illegal bigint, behind array<bigint>, cost bigint, last boolean"
    )
    walked = _spread(ends).mapInArrow(
        _walks, f"{conv}, illegal bigint, cost bigint, last boolean, audits array<string>, exits array<bigint>"
    )
    chosen = _in_one_task(walked, F.col("block")).mapInArrow(
        _forwards, f"{conv}, cost bigint, illegal bigint, entered bigint, audit string"
    )
    return stored(chosen, "edit-scripts")


def _type_of(rows: DataFrame, column: str) -> DataType:
    return rows.schema[column].dataType


def repaired(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """``(conv, row, ord, edit, turn, role, text)`` of the repaired turns, in order of ``row`` and ``ord``.

    Inserted turns have an empty text, no turn, and the row that they come before.
    """
    kind = _type_of(scripts, "conv").simpleString()
    edits = _spread(scripts).mapInArrow(_spelled, f"conv {kind}, row bigint, ord bigint, edit string, role string")
    own = rows.select(F.col("conv").alias("own_conv"), F.col("row").alias("own_row"), "turn", F.col("role").alias("own_role"), "text")
    there = _same("conv", "own_conv") & (F.col("row") == F.col("own_row")) & (F.col("edit") != "I")
    return edits.join(own, there, "left").select(
        "conv",
        "row",
        "ord",
        "edit",
        "turn",
        F.coalesce("role", "own_role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def text_hashes(lines: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of ``role:text``, joined by newlines, of the result of ``repaired``.

    A hash has to see a conversation's text in order, so that alone goes to one
    task, as a stream of chunks.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "ord", line))), lambda x: x["line"]), "\n")
    chunks = lines.groupBy("conv", F.expr(f"row div {CHUNK}").alias("chunk")).agg(joined.alias("lines"))
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", "chunk").select("conv", "lines")
    return ordered.mapInArrow(_hashes, f"conv {_type_of(lines, 'conv').simpleString()}, sha256 string")


def repair_digest(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copy: str | None = None, block: int = BLOCK, stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per conversation.

    Rows of a NULL conversation are one conversation. ``gaps`` are the numbers
    missing between the least and the largest turn. An empty table gives an
    empty result; other columns are not read.
    """
    rows = rows_in_order(turns, conv, turn, role, text, copy, stretch_rows)
    coded = stored(faults(rows), "faults")
    scripts = edit_scripts(coded, block)
    number = lambda name: F.count_if(F.col("fault").eqNullSafe(F.lit(name))).alias(name)
    counted = coded.groupBy("conv").agg(number("blank"), number("duplicate"), number("truncated"))
    between = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(between, F.lit(0)).cast("bigint").alias("gaps"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"])
    audits = scripts.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.max_by("cost", -F.col("block")).alias("cost"),
        F.array_join(whole, "").alias("audit"),
    )
    result = gaps
    for more in (counted, audits, text_hashes(repaired(rows, scripts))):
        result = result.join(more.withColumnRenamed("conv", "_conv"), _same("conv", "_conv"), "left").drop("_conv")
    return result.select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy)`` of conversations damaged by the hash of their row, for trying the repair."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    harm = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(spaced["text"], _ENDS, "")).otherwise(spaced["text"])
    role = F.when(harm == 4, "user").otherwise(spaced["role"])
    copies = F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.filter(harm != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair_digest`` of ``damaged`` rows, with a row for every conversation; zeros if no row is left."""
    digest = repair_digest(damaged(turns), copy="copy")
    every = turns.select("conv_id").distinct()
    both = every.join(digest, _same("conv_id", "conv"), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(
        "conv_id",
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
