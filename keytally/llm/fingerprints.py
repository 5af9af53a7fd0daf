"""Document fingerprints by a threshold-scaled sketch.

A text's shingles are its runs of five words, or all its words if they are fewer.
Of their 64-bit hashes every one below ``FRACTION`` of the range is kept, whatever
the text's length, so a sketch grows with the text and the share of a short
sketch's hashes that a long one holds estimates how much of the short text the
long one contains. The smallest hash is kept as well, so every text with a word
has a fingerprint. Sketches merge: of the union of two, the hashes below the
fraction and the smallest are the sketch of both texts' shingles together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.llm.tables import stored, text_or_empty
from keytally.llm.words import chunks, shingles, words

WIDTH = 5
FRACTION = 1 / 4
#: Parts of the documents in order of their ids; each is a stream of any length.
LEAST_PARTS_A_TASK, MOST_PARTS, PART_ROWS = 4, 4096, 50_000
#: Rows looked at for each part, to cut parts where the rows are.
SAMPLED = 32
_SIGN = -(1 << 63)


def limit_of(fraction: float) -> int:
    return min(int(fraction * (1 << 64)), (1 << 64) - 1)


def sketch_texts(texts: pa.Array, fraction: float = FRACTION, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text, as sorted 64-bit numbers; NULL and wordless texts have none."""
    limit = np.uint64(limit_of(fraction))
    sketches: list[np.ndarray] = []
    for chunk in chunks(texts):
        row, hashed = shingles(words(chunk), width)
        order = np.lexsort((hashed, row))
        row, hashed = row[order], hashed[order]
        smallest = np.ones(len(row), bool)
        smallest[1:] = row[1:] != row[:-1]
        new = smallest.copy()
        new[1:] |= hashed[1:] != hashed[:-1]
        keep = new & (smallest | (hashed < limit))
        row, hashed = row[keep], hashed[keep]
        sketches += np.split(hashed, np.searchsorted(row, np.arange(1, chunk.high - chunk.low)))
    return sketches


def spelled(sketch: np.ndarray) -> str:
    """Base64 of the hashes in order, eight bytes each, the most significant first."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def read_sketch(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The share of the smaller sketch that the other holds, and of both that is common; 1 for two empty ones."""
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / min(len(a), len(b)), common / (len(a) + len(b) - common)


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """``(doc_id, sketch)`` with the hashes as ``array<bigint>``, one row per row of ``docs``.

    Hashes are 64-bit numbers without a sign, held as ``bigint``. NULL and
    wordless texts have an empty sketch; other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketch_texts(batch.column(1), fraction)
            values = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), values], ["doc_id", "sketch"])

    rows = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {kind}, sketch array<bigint>")


def containment(part: str, whole: str) -> Column:
    """Of two sketch columns, the estimated share of the first text's shingles that the second holds; NULL for an empty first."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))


def merged(sketched: DataFrame, by: str, fraction: float = FRACTION) -> DataFrame:
    """``(by, hash)``: the sketch of each group's texts together, one row per hash.

    The hashes are combined before and after a shuffle on both columns, so a
    group may be of any size.
    """
    hashes = sketched.select(by, F.explode("sketch").alias("hash")).distinct()
    order = F.col("hash").bitwiseXOR(F.lit(_SIGN))  # as numbers without a sign
    limit = limit_of(fraction) + _SIGN
    small = hashes.filter(order < limit)
    least = hashes.groupBy(by).agg(F.min(order).bitwiseXOR(F.lit(_SIGN)).alias("hash"))
    return small.unionByName(least).distinct()


def contained_in(sketched: DataFrame, hashes: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_hashes, containment)``: how much of each text a merged collection ``(hash)`` holds.

    Documents without a hash have no row. The collection holds a hash once, so a
    hash that all documents share repeats nothing.
    """
    there = hashes.select("hash").distinct().withColumn("there", F.lit(1))
    each = sketched.select(id, F.explode("sketch").alias("hash")).join(there, "hash", "left")
    held = F.coalesce(F.sum("there"), F.lit(0)) / F.count(F.lit(1))
    return each.groupBy(id).agg(F.count(F.lit(1)).alias("n_hashes"), held.alias("containment"))


# Documents beside the next one in descending order of ids


def _place() -> Column:
    """Text that sorts as the descending id, NULL last, and then a hash of the text."""
    flipped = F.lpad(F.hex(F.bitwise_not("doc_id").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    known = F.when(F.col("doc_id").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), flipped))
    return F.concat(known, F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def _part(bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or before the place, by halving."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def onward(at: Column, step: Column) -> Column:
        to = at + step
        passed = (to <= len(bounds)) & (F.try_element_at(cuts, to) <= F.col("place"))
        return F.when(passed, to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), onward)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(fraction: float):
    """Rows of a part in order, after them the first text of the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row: part, id, text, sketch, whether it is the next part's text
        for batch in batches:
            found: list[list] = [[] for _ in range(9)]
            column = {name: batch[name] for name in ("part", "guest", "doc_id")}
            for chunk in chunks(batch["text"]):
                window = slice(chunk.low, chunk.high)
                texts = batch["text"][window]
                own = sketch_texts(texts, fraction)
                rows = list(zip(*(column[c][window].to_pylist() for c in ("part", "doc_id")), texts.to_pylist(), own, column["guest"][window].to_pylist()))
                pairs = list(zip([before, *rows[:-1]], rows))
                pairs = [(x, y) for x, y in pairs if x is not None and x[0] == y[0] and not x[4]]
                changed = [_edited(x[2], y[2]) for x, y in pairs]
                for (x, y), text, sketch in zip(pairs, changed, sketch_texts(pa.array(changed, pa.string()), fraction)):
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    values = [x[1], len(x[2]), digest, spelled(x[3]), spelled(sketch)]
                    for kept, value in zip(found, [*values, *likeness(x[3], sketch), *likeness(x[3], y[3])]):
                        kept.append(value)
                before = rows[-1]
            kinds = [batch["doc_id"].type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(found, kinds)], NAMES)

    return run


NAMES = [
    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
    "near_edited", "jaccard_edited", "near_next", "jaccard_next",
]


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is that with the next smaller id, NULL last, and after the
    last the first; rows that share an id come by a hash of their text. In the
    edited text the last half of the code points gives way to the first as many
    of the next document, or all it has. ``near_edited`` and ``near_next`` are
    the share of the smaller sketch that the other holds, ``jaccard_`` the share
    of both that is common. A single document is its own next one; an empty table
    gives an empty result. NULL counts as empty; other columns are not read.

    Ids and hashes alone are sorted out first: a sample of them says where to cut
    the order into parts, and the first row of each part goes to the part before
    as well. The texts are then shuffled once, and each part is a sorted stream.
    Rows that repeat both id and text fall in one part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("place", _place())
    places = stored(rows.select("place"), "places")
    number = places.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(tasks * LEAST_PARTS_A_TASK, number // PART_ROWS), MOST_PARTS)
    apart = max(1, number // (parts * SAMPLED))
    seen = sorted(r[0] for r in places.filter(F.pmod(F.xxhash64("place"), F.lit(apart)) == 0).collect())
    part = _part(sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if len(seen) >= parts else [])
    # At most one row for each part.
    heads = places.groupBy(part.alias("part")).agg(F.min("place").alias("head"))
    wide = Window.partitionBy(F.lit(0)).orderBy("part")
    first = F.first("head").over(wide)
    before = heads.select("part", F.coalesce(F.lead("head").over(wide), first).alias("head"))
    asked = F.broadcast(before.withColumnsRenamed({"part": "of"}))
    guests = rows.join(asked, F.col("place") == F.col("head")).groupBy(F.col("of").alias("part")).agg(F.min("text").alias("text"))
    both = rows.select(part.alias("part"), F.lit(False).alias("guest"), "place", "doc_id", "text").unionByName(
        guests.select("part", F.lit(True).alias("guest"), F.lit("").alias("place"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    )
    ordered = both.repartition("part").sortWithinPartitions("part", "guest", "place", "text")
    kinds = ["bigint", "bigint", *["string"] * 3, *["double"] * 4]
    return ordered.mapInArrow(_compared(fraction), ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))
