"""Spelling variants by PartEnum signatures.

A word's letters are a multiset, so a binary vector with a dimension for each
letter and occurrence; all of a letter are in one partition. One inserted or deleted letter changes one dimension and a
replaced one two, so words one edit apart are at a Hamming distance of at most two.
The dimensions are partitioned, and every choice of all partitions but as many as
may differ is a signature: the letters of those partitions, in order. Vectors within the
distance have a signature in common. Words of equal length may differ in two
partitions, words whose lengths differ by one in one, so each has signatures of
its own. Words are joined on equal signatures and verified by their edit distance.

A signature that more than ``BUCKET`` words have is refined by what each word is
without one of its letters: words one edit apart have such a remainder in common,
and a remainder only belongs to as many words as the alphabet allows. (Words of more
than ``LONG`` letters are refined by their halves instead.) So no bucket
makes all its pairs, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import small, stored, text_or_empty

#: Letters of words: ASCII and the upper half of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has to be so many times as frequent as its variant.
TIMES = 5
PARTITIONS = 6
#: Words of a signature that are joined as they are.
BUCKET = 200
#: Longer words are refined by their halves, as leaving out each letter takes their length squared.
LONG = 64
#: One run in so many loses a letter, so that there are variants to find.
SPOILT = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(word: Column) -> Column:
    """A-Z lowered and nothing else; the faster function where both agree."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(doc_id, run)``: every maximal run of at least ``least_length`` letters, A-Z lowered. NULL texts have none."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.col(id).alias("doc_id"), F.explode(found).alias("run"))
    return runs.select("doc_id", _lower_ascii(F.col("run")).alias("run"))


def spoilt(runs: DataFrame) -> DataFrame:
    """``(word)``: the runs, of which one in ``SPOILT`` loses a letter, by the hash of its id and itself.

    A NULL id counts as an empty text.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % SPOILT == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """A stored table ``(word, n)`` of the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.filter(F.col("n") >= least_count), "vocabulary")


def _letters_of(part: int) -> Column:
    """The letters of one partition, in order: those whose code point leaves ``part`` modulo PARTITIONS."""
    return F.array_join(F.filter("letters", lambda c: F.ascii(c) % PARTITIONS == part), "").alias(f"p{part}")


def signatures(words: DataFrame) -> DataFrame:
    """``(word, key)``: the signatures of each word, hashed; a hash shared by chance costs a comparison.

    Signatures for equal lengths hold the length, those for lengths that differ
    by one the larger of both, so a word has them for either role.
    """
    letters = words.select("word", F.sort_array(F.split("word", "")).alias("letters"))
    parted = letters.select("word", F.length("word").alias("size"), *map(_letters_of, range(PARTITIONS)))

    def keys(leaving_out: int, size: Column, family: int) -> list[Column]:
        chosen = combinations(range(PARTITIONS), PARTITIONS - leaving_out)
        return [F.xxhash64(F.lit(family), F.lit(i), size, *[f"p{p}" for p in parts]) for i, parts in enumerate(chosen)]

    size = F.col("size")
    every = keys(2, size, 2) + keys(1, size, 1) + keys(1, size + 1, 1)
    return parted.select("word", F.explode(F.array(*every)).alias("key"))


def without_one(word: str) -> Column:
    """The word itself and all it can become by leaving out one letter."""
    places = F.sequence(F.lit(1), F.length(word))
    cut = F.transform(places, lambda i: F.concat(F.left(F.col(word), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def halves(word: str) -> Column:
    """The halves of a word, as one of two equally long words and as the longer one of two."""
    w, size = F.col(word), F.length(word)

    def of(shorter: Column) -> list[Column]:
        half = (shorter / 2).cast("int")
        name = shorter.cast("string")
        return [F.concat(name, F.lit("<"), F.left(w, half)), F.concat(name, F.lit(">"), F.right(w, half))]

    return F.array(*of(size), *of(size - 1))


def remainders(word: str) -> Column:
    """What two words one edit apart have in common: all but a letter, or a half of words over ``LONG`` letters."""
    size = F.length(word)
    none = F.array().cast("array<string>")
    short = F.when(size <= LONG + 1, without_one(word)).otherwise(none)
    return F.concat(short, F.when(size > LONG, halves(word)).otherwise(none))


def _one_edit(a: str, b: str) -> Column:
    """Exactly one edit; most other pairs share neither their first nor their last half."""
    half = F.expr(f"int(least(length({a}), length({b})) div 2)")
    same_half = (F.left(F.col(a), half) == F.left(F.col(b), half)) | (F.right(F.col(a), half) == F.right(F.col(b), half))
    return same_half & (F.levenshtein(a, b, 1) == 1)


def _joined(keyed: DataFrame, key: str) -> DataFrame:
    other = keyed.select(F.col(key).alias("_key"), F.col("word").alias("other"))
    same = (F.col(key) == F.col("_key")) & (F.col("word") < F.col("other"))
    return keyed.join(other, same & _one_edit("word", "other")).select("word", "other")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A stored table ``(word, other)`` of all pairs of distinct words one edit apart, each once and in order."""
    keyed = stored(signatures(words), "signatures")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.filter(F.col("size") > bucket).select("key"), "large-buckets")
    hint = small(large)
    few = _joined(keyed.join(hint, "key", "left_anti"), "key")
    many = keyed.join(hint, "key", "left_semi").select("word", "key", F.explode(remainders("word")).alias("rest"))
    many = _joined(many.select("word", F.xxhash64("key", "rest").alias("key")), "key")
    return stored(few.unionByName(many).distinct(), "near-words")


def last_forms(forms: DataFrame) -> DataFrame:
    """A stored table ``(word, root)`` from ``(word, form)``: forms followed to the last.

    Each round doubles the steps taken. A form is ``TIMES`` as frequent as its
    word, so there are no circles and the number of rounds grows with the
    logarithm of the logarithm of the largest count.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = at.join(onward, F.col("root") == F.col("_word"), "left")
        at = stored(moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("went")), "roots")
        if at.filter("went").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_groups(counted: DataFrame, times: int = TIMES, bucket: int = BUCKET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per row of the stored table ``(word, n)``.

    A word's form is its near word of largest n, of equal ones the smallest in
    code-point order, if that is at least ``times`` as frequent; its root is the
    last form's form. Words are distinct and not NULL; an empty table gives an
    empty result.
    """
    pairs = near_pairs(counted.select("word"), bucket)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    others = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The least of (-n, word) has the largest n and then the smallest word.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = both.join(others, "other").groupBy("word").agg(best, F.count(F.lit(1)).alias("n_near"))
    seen = counted.join(near, "word", "left").withColumn("best_n", -F.col("best.minus"))
    taken = F.col("best_n") >= times * F.col("n")
    judged = stored(
        seen.select(
            "word",
            F.when(taken, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(taken, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = last_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``spelling_groups`` of the spoilt words of whole texts; columns but the id and the text are not read."""
    return spelling_groups(vocabulary(spoilt(word_runs(docs, id, text))))
