"""Benchmark decontamination by spaced seeds.

A seed mask looks at five of up to ten neighbouring words and ignores the
others, so an overlap is found however a few of its words were replaced. Seed
hashes of the test items are joined with those of the documents, and around each
hit the words are compared along the hit's diagonal: an overlap may hold
substitutions as long as enough of its words agree. The masks are chosen so that
every such overlap holds a seed, wherever its substitutions are. Items with too few
words for a mask are looked up as exact runs of words.

A Bloom filter of the test hashes, of a bounded size, keeps seeds that cannot
join from leaving the scan of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import named_again, numbered, small, stored, text_digest, text_or_empty
from keytally.llm.words import chunks, mix, words

#: Every stretch that ``LEAST_WORDS`` and ``SHARE`` let count has a placement of one
#: of these on agreeing words only; a search over all stretches is in the tests.
MASKS = ("11111", "1101011", "110001011", "10100010011", "11001000011", "110111")
#: An overlap counts from this many agreeing words on (all words of a shorter
#: item), if they are at least this share of its words.
LEAST_WORDS = 10
#: Words a mask looks at; shorter items are looked up whole.
SEED_WORDS = 5
SHARE = 0.7
#: Words kept on either side of a hit for the comparison. A stretch of 30 words that
#: counts has a half that counts, so the smallest ones around a hit fit in.
AROUND = 32
#: The filter has 64 bits for each test hash, but no more than 32 MB; with more
#: hashes it lets more seeds through to the join, and the result is the same.
MAX_BITS = 1 << 28
_PROBES = 3
#: Rows handed to Python at a time.
BATCH_ROWS = 1_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def seeds(hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask ``(position, hash)`` of its placements inside one row."""
    for number, mask in enumerate(MASKS):
        whole = max(len(hashes) - len(mask) + 1, 0)
        rolled = np.full(whole, number + 1, np.uint64)
        for k, seen in enumerate(mask):
            if seen == "1":
                rolled = rolled * _SALT + hashes[k : k + whole]
        at = np.flatnonzero(row[:whole] == row[len(mask) - 1 : len(mask) - 1 + whole])
        yield at, mix(rolled[at])


def _item_seeds(text: Column) -> Column:
    @F.arrow_udf("struct<words: array<bigint>, seeds: array<struct<hash: bigint, at: int>>>")
    def of(texts: pa.Array) -> pa.Array:
        said, found = [], []
        for chunk in chunks(texts):
            w = words(chunk)
            per_row: list[list] = [[] for _ in range(chunk.high - chunk.low)]
            row = w.row
            for at, hashed in seeds(w.hash, row):
                for i, h in zip(at.tolist(), hashed.view(np.int64).tolist()):
                    per_row[row[i]].append({"hash": h, "at": i - int(w.first[row[i]])})
            found += per_row
            said += [w.hash[a:b].view(np.int64) for a, b in zip(w.first[:-1], w.first[1:])]
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(said, pa.list_(pa.int64())), pa.array(found, kind)], ["words", "seeds"])

    return of.asNondeterministic()(F.lower(text))


def bloom_filter(tests: DataFrame) -> np.ndarray:
    """Packed bits of the ``hash`` column's values; its size is bounded by ``MAX_BITS``."""
    bits = 1 << 16
    count = tests.count()
    while bits < min(64 * count, MAX_BITS):
        bits *= 2
    probes = F.array(*[F.shiftrightunsigned("hash", 20 * k).bitwiseAND(F.lit(bits - 1)) for k in range(_PROBES)])
    place = tests.select(F.explode(probes).alias("bit"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))
    set_words = place.groupBy(F.shiftright("bit", 6).alias("at")).agg(word.alias("word")).toArrow()
    packed = np.zeros(bits // 64, np.int64)
    packed[set_words["at"].to_numpy()] = set_words["word"].to_numpy()
    return packed.view(np.uint8)


def _passes(packed: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    left = np.arange(len(hashed))
    limit = np.uint64(len(packed) * 8 - 1)
    for k in range(_PROBES):
        bit = (hashed[left] >> np.uint64(20 * k)) & limit
        left = left[(packed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return left


_SEGMENTS = "array<struct<start: int, words: array<bigint>, hits: array<struct<hash: bigint, at: int>>>>"


def _segments(text: Column, packed: np.ndarray, docs: DataFrame) -> Column:
    """The stretches of a text around seeds that pass the filter: their words, and the seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf(_SEGMENTS)
    def of(texts: pa.Array) -> pa.Array:
        out: list[list] = []
        for chunk in chunks(texts):
            w = words(chunk)
            row = w.row
            places, values = [], []
            for at, hashed in seeds(w.hash, row):
                passed = _passes(shared.value, hashed)
                places.append(at[passed])
                values.append(hashed[passed])
            place, value = np.concatenate(places), np.concatenate(values)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order].view(np.int64)
            per_row: list[list] = [[] for _ in range(chunk.high - chunk.low)]
            far = np.diff(place) > 2 * AROUND
            apart = (far | (row[place[1:]] != row[place[:-1]])) if len(place) else far
            for part in np.split(np.arange(len(place)), np.flatnonzero(apart) + 1):
                if not len(part):
                    continue
                r = row[place[part[0]]]
                low = max(int(w.first[r]), int(place[part[0]]) - AROUND)
                high = min(int(w.first[r + 1]), int(place[part[-1]]) + AROUND)
                hits = [{"hash": h, "at": p - low} for h, p in zip(value[part].tolist(), place[part].tolist())]
                start = low - int(w.first[r])
                per_row[r].append({"start": start, "words": w.hash[low:high].view(np.int64).tolist(), "hits": hits})
            out += per_row
        hit = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(hit))]))
        return pa.array(out, kind)

    return of.asNondeterministic()(F.lower(text))


def _runs(hashes: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, hash)`` of each run of ``length`` words inside one row."""
    whole = max(len(hashes) - length + 1, 0)
    rolled = np.full(whole, length, np.uint64)
    for k in range(length):
        rolled = rolled * _SALT + hashes[k : k + whole]
    at = np.flatnonzero(row[:whole] == row[length - 1 : length - 1 + whole])
    return at, mix(rolled[at])


def _item_runs(said: Column) -> Column:
    """``_runs``'s hash of a whole item, from its words."""

    @F.arrow_udf("bigint")
    def of(items: pa.Array) -> pa.Array:
        found = []
        for item in items:
            hashes = item.values.to_numpy().view(np.uint64)
            found.append(int(_runs(hashes, np.zeros(len(hashes), np.int64), len(hashes))[1].view(np.int64)[0]))
        return pa.array(found, pa.int64())

    return of.asNondeterministic()(said)


def _short_runs(text: Column, packed: np.ndarray, lengths: list[int], docs: DataFrame) -> Column:
    """The distinct runs of ``lengths`` words that pass the filter, each with its first place."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    kind = pa.list_(pa.struct([("run", pa.list_(pa.int64())), ("at", pa.int32())]))

    @F.arrow_udf("array<struct<run: array<bigint>, at: int>>")
    def of(texts: pa.Array) -> pa.Array:
        out: list[list] = []
        for chunk in chunks(texts):
            w = words(chunk)
            row = w.row
            per_row: list[dict] = [{} for _ in range(chunk.high - chunk.low)]
            for length in lengths:
                at, hashed = _runs(w.hash, row, length)
                for i in at[np.sort(_passes(shared.value, hashed))].tolist():
                    run = tuple(w.hash[i : i + length].view(np.int64).tolist())
                    per_row[row[i]].setdefault(run, i - int(w.first[row[i]]))
            out += [[{"run": run, "at": i} for run, i in found.items()] for found in per_row]
        return pa.array(out, kind)

    return of.asNondeterministic()(F.lower(text))


def _short_items(texts: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame | None:
    """``(doc_id, sha, item_id, first, length, agreeing)`` of items too short for a seed; None without such items.

    They are found where all their words stand one after the other.
    """
    short = items.filter(F.size("words").between(1, SEED_WORDS - 1)).select("item_id", "words")
    lengths = sorted(row[0] for row in short.select(F.size("words")).distinct().collect())
    if not lengths:
        return None
    packed = bloom_filter(stored(short.select(_item_runs(F.col("words")).alias("hash")), "runs"))
    found = texts.select("doc_id", "sha", F.explode(_short_runs(F.col("_text"), packed, lengths, docs)).alias("r"))
    met = stored(found.select("doc_id", "sha", "r.*"), "runs", BATCH_ROWS).join(small(short), F.col("run") == F.col("words"))
    n = F.size("run").cast("bigint")
    return met.select("doc_id", "sha", "item_id", F.col("at").cast("bigint").alias("first"), n.alias("length"), n.alias("agreeing"))


def longest_overlap(said: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """``(first, end, agreeing)`` of the overlap along a diagonal with most agreeing words, in positions of ``said``.

    Of all stretches whose agreeing words are at least ``SHARE`` of them, that is
    3 per agreeing and -7 per other word sum to 0 or more; (0, 0, 0) if there is
    none. It begins and ends with an agreeing word; of several the first is taken.
    """
    low, high = max(0, diagonal), min(len(said), len(item) + diagonal)
    if low >= high:
        return 0, 0, 0
    agree = said[low:high] == item[low - diagonal : high - diagonal]
    sums = np.concatenate([[0], np.cumsum(np.where(agree, 3, -7))])
    count = np.concatenate([[0], np.cumsum(agree)])
    # For each end the earliest begin with no larger sum, so with most agreeing words.
    begins = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    agreeing = count - count[begins]
    end = int(np.argmax(agreeing))
    if not agreeing[end]:
        return 0, 0, 0
    same = np.flatnonzero(agree[begins[end] : end]) + int(begins[end])
    return low + int(same[0]), low + int(same[-1]) + 1, int(agreeing[end])


def _compared(said: str, item: str, diagonal: str) -> Column:
    """``longest_overlap`` of two columns of words."""

    @F.arrow_udf("struct<first: int, end: int, agreeing: int>")
    def of(said: pa.Array, items: pa.Array, diagonals: pa.Array) -> pa.Array:
        found = [
            longest_overlap(a.values.to_numpy(), b.values.to_numpy(), d)
            for a, b, d in zip(said, items, diagonals.to_pylist())
        ]
        columns = [pa.array([row[k] for row in found], pa.int32()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, ["first", "end", "agreeing"])

    return of.asNondeterministic()(said, item, diagonal)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, sha, item_id, first_word, end_word, agreeing)``: the overlap of each document and item with most agreeing words.

    Words are lower-cased runs of letters and digits, counted from 0. An item
    of fewer than five words has no seed; it is found where all its words stand
    one after the other, so one of a single word is in every text that has the word.
    NULL texts have no words, and an item without words is found nowhere. Rows that repeat an id and text, whose digest ``sha`` is, are one
    document; items that repeat an id are one item. Other columns are not read. Stored, so it can be used more than once.
    """
    items = benchmark.select(F.col(item).alias("item_id"), _item_seeds(text_or_empty(item_text)).alias("_s"))
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "_s.*"), "items")
    tests = items.select("item", F.explode("seeds").alias("s")).select("item", "s.hash", F.col("s.at").alias("item_at"))
    tests = stored(tests, "tests")
    packed = bloom_filter(tests)

    texts = docs.select(F.col(id).alias("doc_id"), text_digest(text).alias("sha"), text_or_empty(text).alias("_text"))
    found = texts.select("doc_id", "sha", F.explode(_segments(F.col("_text"), packed, docs)).alias("s"))
    found = found.select(F.monotonically_increasing_id().alias("segment"), "doc_id", "sha", "s.*")
    segments = stored(found, "segments", BATCH_ROWS)
    hits = segments.select("segment", F.explode("hits").alias("h")).select("segment", "h.hash", "h.at")
    met = hits.join(small(tests), "hash")
    lines = met.select("segment", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = lines.join(segments.select("segment", "doc_id", "sha", "start", "words"), "segment")
    pairs = pairs.join(small(items.select("item", "item_id", F.col("words").alias("item_words"))), "item")
    judged = pairs.withColumn("o", _compared("words", "item_words", "diagonal"))
    enough = F.least(F.lit(LEAST_WORDS), F.size("item_words"))
    length = F.col("o.end") - F.col("o.first")
    judged = judged.filter((F.col("o.agreeing") >= enough) & (F.col("o.agreeing") >= SHARE * length))
    first = (F.col("start") + F.col("o.first")).cast("bigint")
    counted = judged.select(
        "doc_id", "sha", "item_id", first.alias("first"), length.cast("bigint").alias("length"),
        F.col("o.agreeing").cast("bigint").alias("agreeing"),
    )
    short = _short_items(texts, items, docs)
    counted = counted if short is None else counted.unionByName(short)
    best = F.max(F.struct("agreeing", (-F.col("first")).alias("back"), "length"))
    best = counted.groupBy("doc_id", "sha", "item_id").agg(best.alias("b"))
    return stored(
        best.select(
            "doc_id", "sha", "item_id", (-F.col("b.back")).alias("first_word"),
            (F.col("b.length") - F.col("b.back")).alias("end_word"), "b.agreeing",
        ),
        "overlaps",
    )


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``overlaps``, with those of rows without an id once more under ``sha`` NULL, for rows without id and text."""
    found = overlaps(docs, benchmark)
    return found.unionByName(found.filter("doc_id is null").withColumn("sha", F.lit(None).cast("binary")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_id, first_word, end_word, agreeing)`` per row of ``docs``.

    A row is told by its id, NULL included, and its text, so others under the same
    id are not marked. A row with neither goes with any that has no id. The item
    shown is the one with the most agreeing words, by ties the smallest; without
    any, the columns after ``n_items`` are NULL.
    """
    found = _found(docs, benchmark)
    best = F.max_by(F.struct("item_id", "first_word", "end_word", "agreeing"), F.struct("agreeing", -F.col("item_id")))
    per_doc = found.groupBy("doc_id", "sha").agg(F.count_distinct("item_id").alias("n_items"), best.alias("b"))
    per_doc = stored(per_doc.withColumnsRenamed({"doc_id": "_id", "sha": "_sha"}), "contaminated")
    rows = docs.select("doc_id", text_digest().alias("_is"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_is").eqNullSafe(F.col("_sha"))
    return rows.join(small(per_doc), same, "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), "b.*",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``contamination`` marks, all columns as they were."""
    gone = _found(docs, benchmark).select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_gone_sha"))
    gone = stored(gone.distinct(), "leaks")
    marked = numbered(docs)
    place, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = marked.withColumn("_is", text_digest(text))
    same = F.col(place).eqNullSafe(F.col("_gone")) & F.col("_is").eqNullSafe(F.col("_gone_sha"))
    return marked.join(small(gone), same, "left_anti").select(*named_again(marked, docs))
