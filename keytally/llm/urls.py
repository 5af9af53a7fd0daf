"""URL filters: rules by host and path, and a ratio of two character models for the rest.

The models are Markov models of variable order up to ``ORDER``, one of accepted
and one of rejected URLs, with Witten-Bell interpolation: an order's estimate
takes in the next lower order's by the number of different characters seen after
the context, and a context never seen leaves it as it is. A URL's score is the
mean over its characters of the log ratio of both probabilities. The threshold is
calibrated on URLs that the models have not learned from.

Counting and scoring are joins over the distinct shapes of URLs and their
n-grams, so what is gathered grows with the corpus and no task holds a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import small, stored

ORDER = 5
#: Characters of a shape whose contexts are cut from one row.
PIECE = 1024
#: Hosts with one of these words are the examples of rejected URLs; all others are accepted ones.
REJECTED_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "betting", "payday")

# Fixed values: (verdict, host, path) of the production rules.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"
#: Shapes whose MD5 begins with one of these calibrate; all others are learned from.
_CALIBRATE = "012"


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(start))
        name = F.when(fits, where + start).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def shape_of(host: Column, path: Column) -> Column:
    """What the models read: host and path, every digit as 0."""
    return F.regexp_replace(F.concat(host, path), "[0-9]", "0")


def _grams(shapes: DataFrame, order: int, *kept: str) -> DataFrame:
    """``kept`` and ``gram``, one row for each character of a shape and its end.

    A shape is cut into pieces first, so that no row of a long one carries all of it.
    """
    padded = F.concat(F.lit(_START * order), F.col("shape"), F.lit(_END))
    starts = F.sequence(F.lit(1), F.length("shape") + 1, F.lit(PIECE))
    pieces = F.transform(starts, lambda at: F.substring(padded, at, F.lit(PIECE + order)))
    cut = shapes.select(*kept, F.explode(pieces).alias("piece"))
    each = cut.select(*kept, "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - order)).alias("at"))
    return each.select(*kept, F.substring("piece", F.col("at"), F.lit(order + 1)).alias("gram"))


def log_ratios(shapes: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, ratio)``: of each context and character, log P(rejected) - log P(accepted).

    ``shapes`` is a stored table ``(shape, accepted, rejected)`` with counts to learn from.
    """
    grams = _grams(shapes, order, "accepted", "rejected")
    grams = stored(grams.groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")), "grams")
    lower = None
    for k in range(order + 1):
        seen = grams.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("s")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        seen = seen.withColumn("c", F.substring("s", 1, k))
        contexts = seen.groupBy("c").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        both = seen.join(contexts, "c")
        if lower is None:
            both = both.withColumns({"la": F.lit(1 / 256), "lr": F.lit(1 / 256)})
        else:
            both = both.withColumn("tail", F.substring("s", 2, k)).join(lower, "tail")

        def mixed(count: str, total: str, kinds: str, below: str) -> Column:
            mix = (F.col(count) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds))
            return F.when(F.col(total) > 0, mix).otherwise(F.col(below))

        level = both.select("s", mixed("a", "na", "ta", "la").alias("pa"), mixed("r", "nr", "tr", "lr").alias("pr"))
        level = stored(level, f"order-{k}")
        lower = level.select(F.col("s").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
    return level.select(F.col("s").alias("gram"), (F.log("pr") - F.log("pa")).alias("ratio"))


def score_shapes(shapes: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """``(shape, score)``: the mean log ratio of a shape's characters and its end."""
    keyed = shapes.select("shape", F.unhex(F.sha2(F.col("shape").cast("binary"), 256)).alias("_digest"))
    scores = _grams(keyed, order, "_digest").join(small(ratios), "gram").groupBy("_digest").agg(F.avg("ratio").alias("score"))
    return keyed.join(scores, "_digest").select("shape", "score")


def threshold(scored: DataFrame) -> float:
    """The score as many deviations above the accepted mean as it is below the rejected one.

    ``scored`` has ``(score, n, is_rejected)``. Infinite, so that nothing is
    blocked, if either kind is missing.
    """
    n, x = F.col("n"), F.col("score")
    rows = scored.groupBy("is_rejected").agg(F.sum(n).alias("n"), F.sum(n * x).alias("s"), F.sum(n * x * x).alias("q")).collect()
    of = {row["is_rejected"]: (row["s"] / row["n"], max(row["q"] / row["n"] - (row["s"] / row["n"]) ** 2, 0.0) ** 0.5) for row in rows}
    if len(of) < 2:
        return float("inf")
    (mean_a, dev_a), (mean_r, dev_r) = of[False], of[True]
    dev_a, dev_r = dev_a + 1e-9, dev_r + 1e-9
    return (mean_a * dev_r + mean_r * dev_a) / (dev_a + dev_r)


def filter_urls(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
    rejected_words: tuple[str, ...] = REJECTED_WORDS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per row of ``pages``.

    A NULL url, or one without ``://``, has an empty host and path. Rows that
    repeat an id or url each have their own, equal result. An empty table gives
    an empty result; other columns are not read.
    """
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("host"), F.col("path")))
    rejected = F.col("host").rlike("|".join(rejected_words))
    shapes = rows.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.max(rejected).alias("is_rejected"))
    shapes = stored(shapes.withColumn("learn", ~F.substring(F.md5("shape"), 1, 1).isin([*_CALIBRATE])), "shapes")
    counted = shapes.select(
        "shape",
        F.when(F.col("learn") & ~F.col("is_rejected"), F.col("n")).otherwise(0).alias("accepted"),
        F.when(F.col("learn") & F.col("is_rejected"), F.col("n")).otherwise(0).alias("rejected"),
    )
    scored = stored(shapes.join(score_shapes(shapes, log_ratios(counted)), "shape"), "scores")
    limit = threshold(scored.filter(~F.col("learn")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") > limit, "block").otherwise("allow")
    judged = rows.join(small(scored.select("shape", "score")), "shape", "left")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
