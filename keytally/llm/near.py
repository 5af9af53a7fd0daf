"""Near-duplicate documents by DartMinHash.

A text is a weighted set of its five-word shingles. Each element has an area of
its weight times time in which darts fall at random, as a hash of the element
says; a dart also falls on one of ``BANDS * ROWS`` coordinates. The earliest dart
of each coordinate is the signature: two sets agree on a coordinate with the
probability of their weighted Jaccard similarity. Darts are thrown only until
every coordinate is hit, so a signature costs about t log t darts, however long
the text.

Bands of coordinates are the keys of buckets. Within a bucket all members are
first held against the one with most company; what that leaves in different
components is then held against each other, so a large group of copies never
makes all pairs.
Every link is verified on the exact shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keytally.llm.components import components
from keytally.llm.tables import named_again, numbered, small, stored, text_digest, text_or_empty
from keytally.llm.words import Chunk, chunks, mix, shingles, words

WIDTH = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 meets in a band with 1 - (1 - 0.8**7)**40 > 0.9999.
BANDS, ROWS = 40, 7
#: A bucket with up to so many pairs of different components lists them; up to
#: the second number it is compared in blocks of about ``BLOCK`` by ``BLOCK``
#: members; beyond, it is joined by rare shingles. No way loses a link.
FEW_PAIRS, MOST_PAIRS = 45, 10_000_000
BLOCK = 1_000
#: Shingles on either side of a block, so that long texts make smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: Rows handed to Python at a time.
BATCH_ROWS = 1_000
#: Rows of a chunk whose darts are held together; each has some thousand, however short it is.
DART_ROWS = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xA0761D6478BD642F)


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(0xFFFFFFFF)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1), from 32 bits."""
    return (bits.astype(np.float64) + 0.5) / float(1 << 32)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int, t: int) -> np.ndarray:
    """``rows`` by ``t`` ids of the earliest dart of each coordinate; 0 throughout for an empty row.

    ``elements`` are distinct within a row and ``weights`` positive. An area is
    cut into layers of weight 1 with a sequence of arrivals each, so that equal
    elements share their darts wherever both areas reach.
    """
    layers = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    reach = weights[at] - layer
    seed = mix(elements[at] + layer.astype(np.uint64) * _OTHER)
    row = row[at]
    total = np.bincount(row, np.minimum(reach, 1), rows) if len(row) else np.zeros(rows)
    until = t * (math.log(t) + 3) / np.maximum(total, 1e-9)

    clock = np.zeros(len(seed))
    step = np.ones(len(seed), np.uint64)
    best = np.full(rows * t, np.inf)
    ids = np.zeros(rows * t, np.uint64)
    waiting = np.arange(len(seed))
    while len(waiting):
        cells, times, marks = [], [], []
        # Elements that expect about as many darts go together, that many at a time.
        expected = np.clip(np.ceil(np.log2(np.maximum(until[row[waiting]], 1))), 0, 8).astype(np.int64)
        for level in np.unique(expected):
            live, ahead = waiting[expected == level], np.arange(1 << level, dtype=np.uint64)
            while len(live):
                mark = mix(seed[live, None] + (step[live, None] + ahead) * _GOLD)
                when = -np.log(_unit(mark >> np.uint64(32)))
                when[:, 0] += clock[live]
                np.cumsum(when, axis=1, out=when)
                thrown = when <= until[row[live], None]
                count = thrown.sum(1)
                hit, _ = np.nonzero(thrown)
                cells.append(row[live[hit]] * t + (_low(mark[thrown]) * np.uint64(t) >> np.uint64(32)).astype(np.int64))
                times.append(when[thrown])
                marks.append(mark[thrown])
                part = reach[live[hit]]
                if len(part) and part.min() < 1:
                    inside = _unit(_low(mix(marks[-1] ^ _OTHER))) < part
                    cells[-1], times[-1], marks[-1] = cells[-1][inside], times[-1][inside], marks[-1][inside]
                some = count > 0
                clock[live[some]] = when[some, count[some] - 1]
                step[live] += count.astype(np.uint64)
                live = live[count == len(ahead)]
        cell, when, mark = np.concatenate(cells), np.concatenate(times), np.concatenate(marks)
        np.minimum.at(best, cell, when)
        won = best[cell] == when
        ids[cell[won]] = mark[won]
        missing = np.isinf(best).reshape(rows, t).any(1)
        until[missing] *= 2
        waiting = np.flatnonzero(missing[row])
    return ids.reshape(rows, t)


def band_keys(ids: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    parts = ids.reshape(len(ids), bands, per_band)
    keys = np.arange(bands, dtype=np.uint64)[None, :] * _OTHER + _GOLD
    for k in range(per_band):
        keys = mix(keys * _GOLD + parts[:, :, k])
    return keys.view(np.int64)


def shingle_sets(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, shingle, count)``, distinct within a row and sorted."""
    row, values = shingles(words(chunk), width)
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return row[first], values[first], np.diff(np.append(first, len(row)))


def _fingerprint(chunk: Chunk) -> np.ndarray:
    """128 bits of each row's sequence of words."""
    found = words(chunk)
    rows = len(found.first) - 1
    out = np.zeros((rows, 2), np.uint64)
    place = np.arange(len(found.hash), dtype=np.uint64) - np.repeat(found.first[:-1], np.diff(found.first)).astype(np.uint64)
    for k, salt in enumerate((_GOLD, _OTHER)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found.hash ^ mix(place * salt + salt)), dtype=np.uint64)])
        out[:, k] = mix(sums[found.first[1:]] - sums[found.first[:-1]] + np.diff(found.first).astype(np.uint64))
    return out


def sketch(text: Column, width: int = WIDTH, bands: int = BANDS, per_band: int = ROWS, counted: bool = False) -> Column:
    """``digest`` of the word sequence and ``keys`` of the bands, none for a text without words.

    The weight of a shingle is 1, or with ``counted`` its number of occurrences.
    """

    @F.arrow_udf("struct<digest: binary, keys: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        digests: list[bytes] = []
        keys: list[np.ndarray] = []
        for chunk in chunks(texts):
            rows = chunk.high - chunk.low
            row, values, counts = shingle_sets(chunk, width)
            weights = counts.astype(np.float64) if counted else np.ones(len(row))
            found = []
            for low in range(0, rows, DART_ROWS):
                a, b = np.searchsorted(row, (low, low + DART_ROWS))
                number = min(DART_ROWS, rows - low)
                ids = dart_minhash(values[a:b], weights[a:b], row[a:b] - low, number, bands * per_band)
                found += [*band_keys(ids, bands, per_band)]
            some = np.bincount(row, minlength=rows) > 0
            digests += [pair.tobytes() for pair in _fingerprint(chunk)]
            keys += [k if any_ else k[:0] for k, any_ in zip(found, some)]
        return pa.StructArray.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["digest", "keys"]
        )

    return of.asNondeterministic()(F.lower(text))


def shingle_set(text: Column, width: int = WIDTH, counted: bool = False) -> Column:
    """The distinct shingles of a text, as 64-bit hashes.

    With ``counted`` each further occurrence of a shingle is an element of its own, the
    same in every text, so that the Jaccard similarity of two sets is the weighted one.
    """

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int64()))]
        for chunk in chunks(texts):
            row, values, counts = shingle_sets(chunk, width)
            if counted:
                at = np.repeat(np.arange(len(values)), counts)
                again = (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
                row, values = row[at], np.where(again > 0, mix(values[at] + again * _OTHER), values[at])
            ends = np.searchsorted(row, np.arange(chunk.high - chunk.low + 1)).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))))
        return pa.concat_arrays(parts)

    return of(F.lower(text))


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar; only their documents' texts are read again."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
    texts = docs.join(small(nodes), docs["_id"] == nodes["node"], "left_semi")
    sets = stored(texts.select("_id", shingle_set(F.col("_text"), counted=counted).alias("set")), "sets", BATCH_ROWS)
    left = pairs.join(sets.select(F.col("_id").alias("a"), F.col("set").alias("left")), "a")
    both = left.join(sets.select(F.col("_id").alias("b"), F.col("set").alias("right")), "b")
    return both.filter(jaccard("left", "right") >= similarity).select("a", "b")


def near_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    per_band: int = ROWS,
    few_pairs: int = FEW_PAIRS,
    most_pairs: int = MOST_PAIRS,
    counted: bool = False,
) -> DataFrame:
    """``(doc_id, class_id, class_size, kept)``, one row per row of ``docs``.

    Ids are integers. Two texts are linked if the Jaccard similarity of their sets
    of five-word shingles is at least ``similarity``; with ``counted`` a shingle weighs
    as much as it has occurrences and the weighted similarity counts. A class is a connected
    component and its id the smallest ``doc_id`` in it, which is kept. Words are
    lower-cased runs of letters and digits; a text of fewer than five words is one
    shingle. A text without words, NULL included, is linked to none, and so is a row
    without an id; each such row is kept, with its own id as class. Rows that repeat
    an id are one document: their texts share a class. Other columns are not read.
    """
    plain = docs.select(F.col(id).cast("bigint").alias("_id"), text_or_empty(text).alias("_text"))
    sketches = plain.withColumn("_s", sketch(F.col("_text"), bands=bands, per_band=per_band, counted=counted)).select("_id", "_s.*")
    sketches = stored(sketches, "sketches", BATCH_ROWS)
    usable = sketches.filter(F.col("_id").isNotNull() & (F.size("keys") > 0))
    same = usable.groupBy("digest").agg(F.min("_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = stored(same.select("digest", "a"), "same")
    copies = usable.join(small(same), "digest").filter("_id <> a").select("a", F.col("_id").alias("b"), "digest")
    copies = stored(copies.distinct(), "copies")
    gone = copies.select(F.col("b").alias("_id"), "digest")
    keyed = usable.join(small(gone), ["_id", "digest"], "left_anti").select(F.col("_id").alias("node"), F.explode("keys").alias("key"))

    # Each bucket's members against the one that meets most others in all its buckets.
    buckets = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    crowded = stored(keyed.join(buckets.filter("low < high").select("key", "n"), "key").distinct(), "crowded")
    met = crowded.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = crowded.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("back"))).alias("most"))
    stars = crowded.join(leaders.select("key", (-F.col("most.back")).alias("leader")), "key").filter("node <> leader")
    stars = stored(stars.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "stars")
    links = stored(_verified(stars, plain, similarity, counted), "links")
    placed = components(links)

    # What is left in different components of one bucket, against each other.
    members = crowded.select("key", "node").join(placed, "node", "left")
    members = members.select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    members = stored(members.join(mixed.select("key"), "key"), "members")
    rest, more = _crossing(members, plain, similarity, few_pairs, most_pairs, counted)
    rest = stored(rest.distinct().join(stars, ["a", "b"], "left_anti"), "rest")
    more = more.unionByName(_verified(rest, plain, similarity, counted))

    everything = components(links.unionByName(more).unionByName(copies.select("a", "b")))
    sizes = everything.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    classes = everything.join(sizes, "root")
    classes = stored(classes.select(F.col("node").alias("_id"), F.col("root").alias("class_id"), "class_size"), "classes")
    found = sketches.select("_id").join(small(classes), "_id", "left")
    return found.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        F.coalesce(F.col("class_id") == F.col("_id"), F.lit(True)).alias("kept"),
    )


def _crossing(
    members: DataFrame, docs: DataFrame, similarity: float, few_pairs: int, most_pairs: int, counted: bool
) -> tuple[DataFrame, DataFrame]:
    """Of a bucket's members ``(key, node, root)`` with different roots: pairs to verify, and links.

    The pairs are those of buckets with at most ``few_pairs`` of them, and in
    buckets with more than ``most_pairs`` those that share one of their rarest
    shingles: of two sets of similarity s, the first n - ceil(s * n) + 1
    elements in any common order have one in common, so no link is lost. In
    between, blocks of members are compared at once, and only links come out.
    """
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.sum("c").alias("n"),
        F.max(F.struct("c", "root")).alias("main"),
        ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"),
    )
    sizes = stored(sizes.select("key", "n", "main.c", F.col("main.root").alias("main"), "pairs"), "bucket-sizes")
    pairs = F.col("pairs")
    few = _across(members.join(sizes.filter(pairs <= few_pairs).select("key"), "key"), ["key"])
    between = sizes.filter((pairs > few_pairs) & (pairs <= most_pairs)).drop("pairs")
    links = _block_links(members.join(between, "key"), docs, similarity, counted)
    many = sizes.filter(pairs > most_pairs).select("key")
    if many.isEmpty():
        return few, links
    return few.unionByName(_rare_pairs(members.join(many, "key"), docs, similarity, counted)), links


def _across(rows: DataFrame, on: list[str]) -> DataFrame:
    other = rows.select(*on, F.col("node").alias("other"), F.col("root").alias("other_root"))
    met = rows.join(other, on).filter("root < other_root")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _sets_of(rows: DataFrame, docs: DataFrame, counted: bool) -> DataFrame:
    """``(node, set)`` of the nodes in a stored table."""
    nodes = stored(rows.select("node").distinct(), "nodes")
    texts = docs.join(small(nodes), docs["_id"] == nodes["node"], "left_semi")
    return stored(
        texts.select(F.col("_id").alias("node"), shingle_set(F.col("_text"), counted=counted).alias("set")),
        "node-sets",
        BATCH_ROWS,
    )


def _block_links(large: DataFrame, docs: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """Links of the members outside their bucket's main component, with any other, by blocks.

    A block has about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles on either side,
    whatever the bucket holds. Of a member's links to one component the first is enough.
    """
    large = stored(large, "large-buckets")
    sets = _sets_of(large, docs, counted)
    outer = F.when(F.col("root") != F.col("main"), F.col("size"))
    heavy = large.join(sets.select("node", F.size("set").cast("bigint").alias("size")), "node").groupBy("key").agg(
        F.sum("size").alias("weight"), F.sum(outer).alias("outer_weight")
    )
    large = stored(large.join(heavy, "key"), "weighed-buckets")

    def blocks(n: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, weight / BLOCK_SHINGLES)).cast("int")

    across = blocks(F.col("n"), F.col("weight"))
    down = blocks(F.col("n") - F.col("c"), F.col("outer_weight"))
    place = F.pmod(F.hash("node"), across)
    left = large.filter("root <> main").select(
        "key", "node", "root", F.explode(F.sequence(F.lit(0), across - 1)).alias("i"),
        F.pmod(F.hash("node"), down).alias("j"), F.lit(True).alias("asks"),
    )
    right = large.select(
        "key", "node", "root", place.alias("i"),
        F.explode(F.sequence(F.lit(0), down - 1)).alias("j"), F.lit(False).alias("asks"),
    )
    rows = left.unionByName(right).join(sets, "node")

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        node, root, asks = (block[c].to_numpy() for c in ("node", "root", "asks"))
        sets = block["set"].combine_chunks()
        size = sets.value_lengths().to_numpy()
        starts = np.cumsum(size) - size
        _, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        other = np.flatnonzero(~asks)
        # The other side's codes in one row, and where each member's begin.
        theirs = code[np.concatenate([np.arange(starts[k], starts[k] + size[k]) for k in other])] if len(other) else code[:0]
        begins = np.cumsum(size[other]) - size[other]
        flag = np.zeros(len(code) + 1, bool)
        found: set[tuple[int, int]] = set()
        for k in np.flatnonzero(asks) if len(other) else []:
            mine = code[starts[k] : starts[k] + size[k]]
            flag[mine] = True
            both = np.add.reduceat(flag[theirs], begins, dtype=np.int64)
            flag[mine] = False
            linked = (both >= similarity * (size[k] + size[other] - both)) & (root[other] != root[k])
            _, first = np.unique(root[other[linked]], return_index=True)
            found |= {(min(node[k], x), max(node[k], x)) for x in node[other[linked]][first]}
        a, b = (pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    grouped = rows.select("key", "i", "j", "node", "root", "asks", "set").groupBy("key", "i", "j")
    return stored(grouped.applyInArrow(compare, "a bigint, b bigint"), "block-links")


def _rare_pairs(large: DataFrame, docs: DataFrame, similarity: float, counted: bool) -> DataFrame:
    large = stored(large, "largest-buckets")
    spread = large.join(_sets_of(large, docs, counted), "node").select(
        "key", "node", "root", F.size("set").alias("n"), F.explode("set").alias("shingle")
    )
    spread = stored(spread, "large-shingles")
    common = spread.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rare = F.row_number().over(Window.partitionBy("key", "node").orderBy("df", "shingle"))
    # A shingle of one member comes first in its order and joins with nothing.
    ranked = spread.join(common, ["key", "shingle"], "left").withColumn("df", F.coalesce("df", F.lit(1).cast("bigint")))
    # The small amount keeps a product that should be whole from being rounded up.
    ranked = ranked.withColumn("rank", rare).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    return _across(ranked.filter("df > 1").select("key", "shingle", "node", "root"), ["key", "shingle"])


def _sha(text: str) -> Column:
    """The text's digest; NULL texts are empty."""
    return F.coalesce(text_digest(text), F.unhex(F.sha2(F.lit("").cast("binary"), 256))).alias("_sha")


def _told_apart(docs: DataFrame) -> DataFrame:
    """``(_id, text, _sha)`` of ``docs`` where an id stands for one text only.

    If an id has several texts, that of the smallest digest keeps it and the
    others get numbers no row has, beyond the largest id or else below the least.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text", _sha("text"))
    several = rows.groupBy("_id").agg(F.min("_sha").alias("_first"), F.max("_sha").alias("_last"))
    several = stored(several.filter("_id is not null and _first < _last").select("_id", "_first"), "repeated-ids")
    others = rows.join(small(several), "_id").filter("_sha <> _first").select("_id", "_sha").distinct()
    others = stored(others.withColumn("_at", F.monotonically_increasing_id()), "repeated-texts")
    most = others.agg(F.max("_at")).first()[0]
    if most is None:
        return rows
    low, high = rows.agg(F.min("_id"), F.max("_id")).first()
    if high + most + 1 < 1 << 63:
        number = F.col("_at") + F.lit(high + 1)
    elif low - most - 1 >= -(1 << 63):
        number = F.lit(low - 1) - F.col("_at")
    else:
        raise ValueError("ids at both ends of bigint, and some have several texts")
    own = others.select("_id", "_sha", number.alias("_own"))
    rows = rows.join(small(own), ["_id", "_sha"], "left")
    return rows.select("_id", "text", "_sha", F.coalesce("_own", "_id").alias("_own"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, all columns as they were.

    Shingles weigh as much as they occur. Different texts under one id are documents of
    their own here.
    """
    apart = _told_apart(docs)
    if "_own" not in apart.columns:
        apart = apart.withColumn("_own", F.col("_id"))
    gone = near_groups(apart, id="_own", counted=True).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = stored(gone, "near")
    keys = apart.join(small(gone), apart["_own"] == gone["_gone"], "left_semi").select(F.col("_id").alias("_gone"), "_sha")
    keys = stored(keys.distinct(), "near-rows").withColumnRenamed("_sha", "_gone_sha")
    marked = numbered(docs)
    place, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = marked.select("*", _sha(text))
    same = (F.col(place) == F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha"))
    return marked.join(small(keys), same, "left_anti").select(*named_again(marked, docs))
