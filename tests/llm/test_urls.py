import math
from collections import Counter

from keytally.llm import urls


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/de/"), (3, "x://net"), (4, "http://net/"),
        (5, "http://b.org/fr/a#b"), (6, "http://notexample.com/de/x"), (7, "http://m.example.com/de/x"), (8, None),
        (9, "no scheme.net/"), (10, "http://É.ORG?x/fr/"), (4, "http://net/"), (None, "a://b://c/d"),
    ]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 host", "2 score")).collect()
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by_id == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"),
        3: ("net", "", None, "allow"), 4: ("net", "/", "net/", "block"), 5: ("b.org", "/fr/a", "org/fr/", "allow"),
        6: ("notexample.com", "/de/x", None, "allow"), 7: ("m.example.com", "/de/x", "example.com/de/", "block"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("É.org", "", None, "allow"),
        None: ("b:", "//c/d", None, "allow"),
    }


def _model(texts: list[str], order: int):
    counts = Counter()
    for t in texts:
        padded = urls._START * order + t + urls._END
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i], padded[i]] += 1

    def probability(context: str, char: str) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            after = {ch: n for (ctx, ch), n in counts.items() if ctx == c}
            if after:
                p = (after.get(char, 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    return probability


def test_scores_equal_brute_force(spark, monkeypatch):
    order = 2
    monkeypatch.setattr(urls, "PIECE", 3)
    accepted, rejected = ["abc/d", "abd", "acb/"], ["xab", "xx/y"]
    shapes = [(t, 1, 0) for t in accepted] + [(t, 0, 1) for t in rejected] + [("new", 0, 0), ("", 0, 0)]
    frame = spark.createDataFrame(shapes, "shape string, accepted bigint, rejected bigint")
    got = {r["shape"]: r["score"] for r in urls.score_shapes(frame, urls.log_ratios(frame, order), order).collect()}
    yes, no = _model(accepted, order), _model(rejected, order)
    for shape, *_ in shapes:
        padded = urls._START * order + shape + urls._END
        parts = [math.log(no(padded[i - order : i], padded[i]) / yes(padded[i - order : i], padded[i])) for i in range(order, len(padded))]
        assert abs(got[shape] - sum(parts) / len(parts)) < 1e-9


def test_the_threshold_lies_between(spark):
    frame = spark.createDataFrame([(-2.0, 3, False), (-1.0, 1, False), (2.0, 2, True)], "score double, n bigint, is_rejected boolean")
    assert -1 < urls.threshold(frame) < 2.1
    assert urls.threshold(frame.filter("not is_rejected")) == math.inf
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_a_url_of_a_megabyte(spark):
    """Its characters are cut out in pieces; whole, they would be as many rows of a megabyte."""
    long = "".join(chr(97 + i * i % 23) for i in range(1_000_000))
    rows = [(i, f"http://host{i}.org/{'ab' * (i % 7)}") for i in range(40)] + [(99, f"http://long.org/{long}"), (100, "http://spam.org/x")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(got) == 42 and len(got[99]["path"]) == 1_000_001 and got[99]["score"] is not None
    pieces = urls._grams(spark.createDataFrame([("x" * 5_000,), ("",)], "shape string"), 5, "shape")
    assert sorted(r["count"] for r in pieces.groupBy("shape").count().collect()) == [1, 5_001]
