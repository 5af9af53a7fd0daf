"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams, for n from 1 to 3, that
are present in both (a blended spectrum of presences), over the root of the
product of their own numbers. A few training texts per language are landmarks;
the Nystroem features of a text are its kernel values with them, and one ridge
regression per language is fitted on those features. A batch of texts is scored
by two matrix products: presences by landmarks, and kernel values by weights.

The model is fitted on a bounded sample: at most ``per_lang`` texts of each
language, of which ``landmarks`` are landmarks, and fewer with many languages, so
that ``MOST_TEXTS`` and ``MOST_LANDMARKS`` bound both in total. A language keeps
one text at least. Everything else sees whole texts.

The best of K regressions is never below about 2/K - 1, so it cannot tell that a
text is in none of the languages. That is told by the share of a text's distinct
3-grams that some landmark has, against a cut found when the model is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keytally.llm.tables import held_out, named_again, numbered, small, stored, text_or_empty
from keytally.llm.words import Chunk, chunks

PER_LANG = 400
LANDMARKS = 32
#: Bounds over all languages. With more languages than landmarks the first ones have one each.
MOST_TEXTS = 16_000
MOST_LANDMARKS = 1_024
#: Entries of a presence matrix of rows by n-grams; longer batches are scored in parts.
MOST_ENTRIES = 1 << 23
RIDGE = 1e-3
#: The cut is halfway between the known share that all but this part of the labelled
#: texts exceed, and the one that all but this part stay below if the landmarks of
#: their own language are left out.
CLEAN_TAIL = 0.005
FOREIGN_TAIL = 0.05
#: A text is rejected if one at the cut would show so small a share by chance once in
#: twenty times: so many standard errors below, which are large in short texts only.
ERRORS = 1.64
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    """0 for ASCII other than letters, 1 to 26 for letters in either case, then each other byte."""
    table = np.zeros(256, np.int32)
    table[0x41:0x5B] = table[0x61:0x7B] = np.arange(1, 27)
    table[0x80:] = np.arange(27, 27 + 128)
    return table


_SYMBOL = _symbols()
_BASE = 155
_STARTS = (0, _BASE, _BASE + _BASE**2)
CODES = _BASE + _BASE**2 + _BASE**3


def gram_codes(chunk: Chunk) -> Iterator[np.ndarray]:
    """For n = 1, 2, 3 the code of the n-gram at each byte, or -1 where it would leave its row."""
    symbols = _SYMBOL[chunk.data]
    codes = symbols
    yield codes
    for n in (2, 3):
        whole = max(len(symbols) - n + 1, 0)
        codes = codes[:whole] * _BASE + symbols[n - 1 : n - 1 + whole]
        placed = codes + _STARTS[n - 1]
        ends = chunk.offsets[1:-1]
        for back in range(1, n):
            edge = ends - back
            placed[edge[(edge >= 0) & (edge < whole)]] = -1
        yield placed


def parts(chunk: Chunk, width: int) -> Iterator[Chunk]:
    """The chunk in pieces whose presence matrices have at most ``MOST_ENTRIES`` entries, or one row."""
    rows = len(chunk.offsets) - 1
    step = max(1, MOST_ENTRIES // max(width, 1))
    for low in range(0, rows, step):
        places = chunk.offsets[low : low + step + 1]
        high = low + len(places) - 1
        yield Chunk(chunk.low + low, chunk.low + high, chunk.data[places[0] : places[-1]], places - places[0])


class Model(NamedTuple):
    langs: list[str]
    column: np.ndarray  # code -> column of the presence matrix, 0 for none
    landmarks: np.ndarray  # columns by landmarks, over the root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks by languages
    cut: float  # texts whose known share is below are in none of the languages


def _presence(chunk: Chunk, column: np.ndarray, width: int) -> np.ndarray:
    """Row by row, which of the landmarks' n-grams a text has."""
    rows = len(chunk.offsets) - 1
    present = np.zeros((rows, width), np.float32)
    flat = present.reshape(-1)
    base = np.repeat(np.arange(rows, dtype=np.int64) * width, np.diff(chunk.offsets))
    for codes in gram_codes(chunk):
        flat[base[: len(codes)] + column[codes]] = 1  # the last entry, for code -1, is 0
    present[:, 0] = 0
    return present


def known_share(chunk: Chunk, column: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the share of the distinct 3-grams that some landmark has, and their number.

    ``present`` is the chunk's ``_presence``. Shorter n-grams stand in for 3-grams
    in a text of one or two bytes; an empty one has share 0.
    """
    rows = len(present)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(chunk.offsets))
    share, number = np.zeros(rows), np.zeros(rows)
    for n, codes in enumerate(gram_codes(chunk)):
        end = CODES if n == 2 else _STARTS[n + 1]
        columns = column[_STARTS[n] : end]
        some = present[:, np.sort(columns[columns > 0])].sum(1)
        new = np.flatnonzero((column[codes] == 0) & (codes >= 0))
        distinct = np.unique(row[new] * CODES + codes[new])
        total = some + np.bincount(distinct // CODES, minlength=rows)
        share = np.where(total > 0, some / np.maximum(total, 1), share)
        number = np.where(total > 0, total, number)
    return share, number


def learned(share: np.ndarray, number: np.ndarray, cut: float) -> np.ndarray:
    """Whether a share of ``number`` n-grams may be that of a text in a learned language."""
    return share >= cut - ERRORS * np.sqrt(cut * (1 - cut) / np.maximum(number, 1))


def indices(langs: list[str]) -> dict[str, list[int]]:
    """Which texts are in each language, by name."""
    found: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        found.setdefault(lang, []).append(i)
    return dict(sorted(found.items()))


def cut_of(grams: list[np.ndarray], langs: list[str], chosen: list[int]) -> float:
    """The least known share of texts in the learned languages, from the fitted texts themselves.

    A text is compared with all landmarks but itself, and once more with those of the
    other languages only, which is how a language looks that was not learned.
    Where the two overlap, the clean texts decide.
    """
    having = np.zeros(CODES, np.int32)
    for i in chosen:
        having[grams[i]] += 1
    marks = set(chosen)
    several = len({langs[i] for i in chosen}) > 1
    clean, foreign = [], []
    own = np.zeros(CODES, np.int32)
    for name, texts in indices(langs).items():
        marked = [i for i in texts if i in marks]
        if not marked:
            continue
        for i in marked:
            own[grams[i]] += 1
        for i in texts:
            longest = grams[i][grams[i] >= _STARTS[2]]
            if not len(longest):
                continue
            if len(chosen) > 1:
                clean.append(np.mean(having[longest] > (i in marks)))
            if several:
                foreign.append(np.mean(having[longest] > own[longest]))
        for i in marked:
            own[grams[i]] = 0
    low = float(np.quantile(clean, CLEAN_TAIL)) if clean else 0.0
    high = float(np.quantile(foreign, 1 - FOREIGN_TAIL)) if foreign else 0.0
    return min(low, (low + high) / 2)


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return present @ landmarks / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))


def fit(grams: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features of distinct codes per text.

    The first ``landmarks`` texts of each language are the landmarks, or as many as
    ``MOST_LANDMARKS`` allows. Each language has the same weight in every regression,
    however many texts it has.
    """
    by_lang = indices(langs)
    names = list(by_lang)
    landmarks = min(landmarks, max(1, MOST_LANDMARKS // max(len(names), 1)))
    chosen = [i for name in names[:MOST_LANDMARKS] for i in by_lang[name][:landmarks]]
    known = np.unique(np.concatenate([grams[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
    column = np.zeros(CODES + 1, np.int32)
    column[known] = np.arange(1, len(known) + 1)

    def presence(texts: list[int]) -> np.ndarray:
        present = np.zeros((len(texts), len(known) + 1), np.float32)
        for row, i in enumerate(texts):
            present[row, column[grams[i]]] = 1
        present[:, 0] = 0
        return present

    step = max(1, MOST_ENTRIES // (len(known) + 1))
    marks = presence(chosen)
    marks = (marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T.copy()
    if not chosen:
        return Model(names, column, marks, np.zeros((0, 0), np.float32), 0.0)
    values = np.concatenate([kernel(presence(list(range(k, min(k + step, len(grams))))), marks) for k in range(0, len(grams), step)])
    values = values.astype(np.float64)
    spread, basis = np.linalg.eigh(values[chosen])
    kept = spread > 1e-6 * spread.max()
    root = basis[:, kept] / np.sqrt(spread[kept])
    features = np.concatenate([values @ root, np.ones((len(values), 1))], 1)
    target = np.full((len(langs), len(names)), -1.0)
    for k, name in enumerate(names):
        target[by_lang[name], k] = 1.0
    share = np.array([len(by_lang[lang]) for lang in langs], np.float64)
    weighted = features / share[:, None]
    size = features.shape[1]
    solved = np.linalg.solve(weighted.T @ features + ridge * np.eye(size), weighted.T @ target)
    weights = np.concatenate([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return Model(names, column, marks, weights, cut_of(grams, langs, chosen))


def labelled(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, text)`` of the rows that may be learned from: an id not held out, a language, a letter."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    return rows.filter(F.rlike("text", F.lit(r"\p{L}")))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``(doc_id, lang)`` of at most ``per_lang`` labelled documents per language, by hash of the id.

    An id counts once in a language, however many rows have it. A language's ids are
    thinned by their number first, so no task sorts them all.
    """
    ids = stored(labelled(docs).select("doc_id", "lang").distinct(), "labelled")
    counts = stored(ids.groupBy("lang").count(), "languages")
    per_lang = min(per_lang, max(1, MOST_TEXTS // max(counts.count(), 1)))
    rates = counts.select("lang", (F.lit(2.0 * per_lang + 20) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    drawn = ids.withColumn("draw", draw).join(small(rates), "lang").filter("draw < rate")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("doc_id", "lang")


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """Fit on the sampled documents' whole texts; their distinct n-grams are found on the executors.

    Of rows that share an id and a language the smallest text is learned from.
    """

    @F.arrow_udf("array<int>")
    def distinct_grams(texts: pa.Array) -> pa.Array:
        found: list[np.ndarray] = []
        for chunk in chunks(texts):
            placed = list(gram_codes(chunk))
            for low, high in zip(chunk.offsets[:-1], chunk.offsets[1:]):
                codes = np.unique(np.concatenate([codes[low:high] for codes in placed]))
                found.append(codes[codes >= 0])
        return pa.array(found, pa.list_(pa.int32()))

    sample = stored(training_sample(docs, per_lang), "sample")
    rows = labelled(docs).join(small(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "lang", distinct_grams("text").alias("grams")).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    grams = [codes.values.to_numpy().astype(np.int64) for codes in rows["grams"]]
    return fit(grams, rows["lang"].to_pylist(), landmarks)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``learned``; all other columns of ``docs`` stay as they are.

    A text that is NULL or has no letter, and any text if nothing could be
    learned, is ``und`` with score 0 and not ``learned``. The score is the best
    regression's value, moved from -1..1 to 0..1 and cut to that range; it ranks
    the learned languages only. Ties go to the first name. ``learned`` tells whether
    the text's 3-grams are those of the learned languages at all.
    """
    # A plain tuple: executors need no copy of this package to read it.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("struct<lang_pred: string, score: double, learned: boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        names, scores, kept = [], [], []
        width = len(model.landmarks)
        for chunk in (part for whole in chunks(texts) for part in parts(whole, width)):
            present = _presence(chunk, model.column, width)
            values = kernel(present, model.landmarks)
            found = values @ model.weights[:-1] + model.weights[-1]
            best = found.argmax(1)
            names += [model.langs[i] for i in best]
            scores += [float(x) for x in np.clip((1 + found[np.arange(len(best)), best]) / 2, 0, 1)]
            kept += learned(*known_share(chunk, model.column, present), model.cut).tolist()
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "learned"])

    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "learned": F.lit(False)})
    judged = docs.withColumn("_judged", judge.asNondeterministic()(text_or_empty(text)))
    letters = F.rlike(text_or_empty(text), F.lit(r"\p{L}"))
    return judged.withColumns(
        {
            "lang_pred": F.when(letters, F.col("_judged.lang_pred")).otherwise(UNKNOWN),
            "score": F.when(letters, F.col("_judged.score")).otherwise(0.0),
            "learned": letters & F.col("_judged.learned"),
        }
    ).drop("_judged")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those in no learned language, all columns as they were."""
    model = train(docs)
    judged = predict(numbered(docs), model, f"_{docs.columns.index('text')}")
    judged = judged.filter("learned")
    return judged.select(*named_again(judged, docs))
