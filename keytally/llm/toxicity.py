"""Toxicity by logistic regression, learned online with FTRL-proximal.

The features of a text are the hashes of its words, of the words' beginnings
(which stand for their inflected forms), of neighbouring pairs, and of pairs
with one word skipped; each counts once. FTRL-proximal keeps a rate of its own
for each feature and sets weights to zero unless their gradients add up to
more than ``L1``, so the model is a short list of hashes and weights.

Learning takes a bounded sample of at most ``TRAIN_ROWS`` labelled rows in parts
of about ``PART_ROWS``. Each part is learned in its own task; the model is the
mean of their weights. Scoring reads all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import held_out, one_of_repeated, stored, text_or_empty
from keytally.llm.words import Chunk, chunks, mix, prefix_hashes, words

TRAIN_ROWS = 16_000
PART_ROWS = 4_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
#: Features of fewer texts of a part are left out of its learning.
LEAST_TEXTS = 3
#: Bytes of the beginnings of words.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_SALTS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, hash)`` of each kind of feature, repeats included."""
    found = words(chunk)
    row, word = found.row, found.hash
    yield row, word
    for salt, length in zip(_SALTS, PREFIXES):
        longer = np.flatnonzero(found.end - found.start > length)
        yield row[longer], mix(prefix_hashes(chunk, found.start[longer], length) ^ salt)
    for salt, step in ((_SALTS[6], 1), (_SALTS[7], 2)):
        whole = max(len(word) - step, 0)
        inside = np.flatnonzero(row[:whole] == row[step:])
        yield row[inside], mix(word[inside] * salt + word[inside + step])


class Model(NamedTuple):
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of features ``0..size`` and the bias, from each row's distinct feature numbers."""
    z, n = np.zeros(size), np.zeros(size)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at = rows[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - labels[i]
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            bias -= 0.01 * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def learn_part(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(hashes, weights, bias)`` with the nonzero weights of one part."""
    known, texts = np.unique(np.concatenate(rows), return_counts=True)
    known = known[texts >= LEAST_TEXTS]
    numbered = []
    for row in rows:
        at = np.searchsorted(known, row)
        at[at == len(known)] = 0
        numbered.append(at[known[at] == row] if len(known) else at[:0])
    weights, bias = ftrl(numbered, labels, len(known))
    used = np.flatnonzero(weights)
    return known[used], weights[used], bias


def distinct_features(chunk: Chunk) -> list[np.ndarray]:
    parts = [*features(chunk)]
    row = np.concatenate([r for r, _ in parts])
    value = np.concatenate([h for _, h in parts])
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(chunk.high - chunk.low + 1))
    value = value[order]
    return [np.unique(value[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, part_rows: int = PART_ROWS) -> Model:
    """Learn ``toxic`` from labelled rows that are not held out.

    Labels that are NULL and rows without an id are not learned from; of
    labels for one id the largest counts, and of rows that share an id one
    text, of the smallest hash, so a part has at most about ``part_rows`` texts. Without any row to learn from the
    model has no weights and gives the score 0.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 31)) / float(1 << 31)
    taken = known.withColumn("draw", draw).filter(F.col("draw") < 1.2 * rows / max(total, 1))
    taken = stored(taken.orderBy("draw", "doc_id").limit(rows).select("doc_id", "toxic", "draw"), "taken")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.withColumn("h", F.xxhash64("text"))
    # Texts themselves are combined only for the ids that have one more than once.
    first = texts.groupBy("doc_id", "h").count().groupBy("doc_id").agg(F.min(F.struct("h", "count")).alias("f"))
    first = stored(first.select("doc_id", "f.*"), "chosen")
    texts = texts.join(F.broadcast(first.select("doc_id", "h")), ["doc_id", "h"])
    texts = one_of_repeated(texts, ["doc_id"], first.filter("count > 1").select("doc_id"))
    parts = texts.select((F.col("draw") * (1 << 20)).cast("int").alias("part"), "text", "toxic", "doc_id")
    parts = parts.withColumn("part", F.pmod("part", F.lit(-(-min(total, rows) // part_rows) or 1)))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        text = table["text"].combine_chunks()
        found = [row for chunk in chunks(text) for row in distinct_features(chunk)]
        hashes, weights, bias = learn_part(found, table["toxic"].to_numpy().astype(np.float64))
        hashes, weights = np.append(hashes, np.uint64(0)), np.append(weights, bias)
        return pa.table({"hash": hashes.view(np.int64), "weight": weights, "bias": np.arange(len(hashes)) == len(hashes) - 1})

    learned = parts.groupBy("part").applyInArrow(learn, "hash bigint, weight double, bias boolean")
    # As many rows as the parts have nonzero weights, which the sample bounds.
    mean = learned.groupBy("hash", "bias").agg((F.sum("weight")).alias("weight"), F.count(F.lit(1)).alias("n"))
    mean = sorted(mean.collect(), key=lambda row: row["hash"] & 0xFFFFFFFFFFFFFFFF)
    biases = [row for row in mean if row["bias"]]
    if not biases:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    parts_learned = biases[0]["n"]
    used = [row for row in mean if not row["bias"]]
    hashes = np.array([row["hash"] for row in used], np.int64).view(np.uint64)
    weights = np.array([row["weight"] / parts_learned for row in used])
    return Model(hashes, weights, biases[0]["weight"] / parts_learned)


def scores(chunk: Chunk, model: Model, filter_: np.ndarray) -> np.ndarray:
    rows, places = [], []
    for row, hashed in features(chunk):
        maybe = np.flatnonzero(filter_[hashed & np.uint64(len(filter_) - 1)])
        at = np.searchsorted(model.hashes, hashed[maybe])
        at[at == len(model.hashes)] = 0
        real = model.hashes[at] == hashed[maybe]
        rows.append(row[maybe[real]])
        places.append(at[real])
    size = len(model.hashes)
    once = np.unique(np.concatenate(rows) * size + np.concatenate(places))
    total = np.bincount(once // size, model.weights[once % size], chunk.high - chunk.low)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability of ``toxic``; a text without words, NULL included, has the bias's alone."""
    # A plain tuple: executors need no copy of this package to read it.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    empty = float(1 / (1 + np.exp(-model.bias)))
    if not len(model.hashes):
        return F.lit(empty)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        filter_ = np.zeros(1 << 18, bool)
        filter_[model.hashes & np.uint64(len(filter_) - 1)] = True
        found = [scores(chunk, model, filter_) for chunk in chunks(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return of.asNondeterministic()(text_or_empty(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``."""
    model = train(docs, labels)
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
