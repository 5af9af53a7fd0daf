import numpy as np
import pyarrow as pa
from keytally.llm import language
from keytally.llm.words import chunks


def test_presence_is_the_set_of_grams():
    texts = ["Abc, abé", "", "b", "xyabx"]
    column = np.zeros(language.CODES + 1, np.int32)
    column[:-1] = 1
    for limit in (1, 1 << 20):
        seen = []
        for chunk in chunks(pa.array(texts), limit):
            codes = list(language.gram_codes(chunk))
            for low, high in zip(chunk.offsets[:-1], chunk.offsets[1:]):
                seen.append({int(c) for part in codes for c in part[low:high] if c >= 0})
        for text, found in zip(texts, seen):
            symbols = [int(language._SYMBOL[b]) for b in text.encode()]
            want = set()
            for n in (1, 2, 3):
                for i in range(len(symbols) - n + 1):
                    code = 0
                    for s in symbols[i : i + n]:
                        code = code * language._BASE + s
                    want.add(code + language._STARTS[n - 1])
            assert found == want


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = language.predict(docs, language.train(docs)).filter("crc32(cast(doc_id as string)) % 4 = 2")
    right, all_ = judged.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert all_ > 100 and right / all_ > 0.98
    assert judged.filter("score < 0 or score > 1").isEmpty()


def test_edges(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs, per_lang=60)
    got = language.predict(edge_docs.select("doc_id", "text"), model).collect()
    assert len(got) == edge_docs.count()
    for row in got:
        if row["text"] is None or row["text"].strip() == "" or row["doc_id"] == 8:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in {"de", "en", "es", "fr"} and 0 <= row["score"] <= 1
    assert language.predict(no_docs, model).count() == 0
    nothing = language.train(no_docs)
    assert {r["lang_pred"] for r in language.predict(edge_docs, nothing).collect()} == {"und"}


def test_stage_keeps_clean_documents_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame(
        [(-1, "12 34 !?", "en", "s", 1), (-2, None, None, None, None), (-3, "", "fr", "s", 0)], docs.schema
    )
    kept = language.keep_known(docs.unionByName(extra))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


NOT_LEARNED = [
    "这是一个没有学习过的语言的文本，应该被拒绝。",
    "هذا نص باللغة العربية لا ينتمي إلى أي لغة معروفة",
    "Это русский текст, который не относится ни к одному из изученных языков",
    "Όλα αυτά τα κείμενα είναι γραμμένα στα ελληνικά",
    "To jest polski tekst, którego model nigdy wcześniej nie widział ani się nie uczył",
    "Tämä on suomenkielinen teksti, jota ei ole opittu missään vaiheessa",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IHdpdGggbm8gbWVhbmluZw==",
    "def __init__(self, x_1): self._q = getAttr(x_1); kZ9 = fooBarBaz(qux)",
]


def test_stage_rejects_what_was_not_learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = [(-10 - k, text * n, None, "s", 1) for k, text in enumerate(NOT_LEARNED) for n in (1, 20)]
    kept = language.keep_known(docs.unionByName(spark.createDataFrame(others, docs.schema)))
    assert kept.filter("doc_id < 0").isEmpty() and kept.count() == docs.count()


def test_a_language_left_out_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for left in ("de", "es", "fr"):
        model = language.train(docs.filter(f"lang <> '{left}'"))
        judged = language.predict(docs, model).filter("length(text) > 100")
        kept, all_ = judged.filter(f"lang = '{left}'").selectExpr("count_if(learned)", "count(*)").first()
        assert all_ > 50 and kept < 0.1 * all_
        assert judged.filter(f"lang <> '{left}' and not learned").count() < 5


def test_rows_are_learned_from_by_their_own_label(spark, monkeypatch):
    """Rows of a shared id: only those with a language count, once each, however often they are repeated."""
    rows = [(1, "the english text", "en"), (1, "ein deutscher satz", None), (1, "un texte", "fr")] * 500
    rows += [(4, "ein anderer satz", "de"), (4, "999", "de"), (2, None, "de"), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {(r["doc_id"], r["lang"]) for r in language.training_sample(docs).collect()}
    assert learned == {(1, "en"), (1, "fr"), (4, "de")}
    seen = []
    monkeypatch.setattr(language, "fit", lambda grams, langs, landmarks: seen.append((grams, langs)))
    language.train(docs)
    texts = {"de": "ein anderer satz", "en": "the english text", "fr": "un texte"}
    (grams, langs), = seen
    assert langs == [*texts]
    for codes, text in zip(grams, texts.values()):
        chunk = next(chunks(pa.array([text])))
        assert set(codes.tolist()) == {int(c) for part in language.gram_codes(chunk) for c in part if c >= 0}


def _plain_ridge(grams, langs, marks, text, ridge=language.RIDGE):
    """Kernel ridge regression in the span of the landmarks, by sets and a pseudo-inverse root."""
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    names = sorted(set(langs))
    among = np.array([[k(grams[i], grams[j]) for j in marks] for i in marks])
    spread, basis = np.linalg.eigh(among)
    root = basis / np.sqrt(spread)
    features = lambda s: np.append(np.array([k(s, grams[j]) for j in marks]) @ root, 1)
    x = np.array([features(s) for s in grams])
    scale = np.sqrt(1 / np.array([langs.count(lang) for lang in langs]))[:, None]
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    # The same problem as ordinary least squares with the ridge as further rows.
    a = np.concatenate([x * scale, np.sqrt(ridge) * np.eye(x.shape[1])])
    b = np.concatenate([y * scale, np.zeros((x.shape[1], len(names)))])
    return features(text) @ np.linalg.lstsq(a, b, rcond=None)[0]


def test_fit_equals_plain_kernel_ridge_regression():
    rng = np.random.default_rng(2)
    langs = [f"l{i % 3}" for i in range(30)]
    grams = [np.unique(np.concatenate([rng.integers(0, 60, 15), rng.integers(60, 90, 8) + 30 * (i % 3)])) for i in range(30)]
    model = language.fit([g.astype(np.int64) for g in grams], langs, landmarks=4)
    sets = [set(g.tolist()) for g in grams]
    marks = [i for name in ("l0", "l1", "l2") for i in [k for k, lang in enumerate(langs) if lang == name][:4]]
    known = set().union(*[sets[i] for i in marks])
    sets = [s & known for s in sets]
    for s in sets:
        present = np.zeros((1, len(model.landmarks)), np.float32)
        present[0, model.column[sorted(s)]] = 1
        got = language.kernel(present, model.landmarks) @ model.weights[:-1] + model.weights[-1]
        assert np.allclose(got[0], _plain_ridge(sets, langs, marks, s), atol=5e-3)


def test_many_languages_and_many_empty_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANDMARKS", 60)
    monkeypatch.setattr(language, "MOST_TEXTS", 300)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(5)
    own = {f"l{k:02d}": ["".join(rng.choice(list(alphabet), 5)) for _ in range(12)] for k in range(50)}
    rows = [(i, " ".join(rng.choice(own[f"l{i % 50:02d}"], 30)), f"l{i % 50:02d}") for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language.training_sample(docs).groupBy("lang").count().collect()
    assert len(sample) == 50 and max(r["count"] for r in sample) == 6
    model = language.train(docs)
    assert len(model.langs) == 50 and model.landmarks.shape[1] == 50
    right = language.predict(docs, model).filter("lang = lang_pred").count()
    assert right > 950
    # Presences of 10,000 empty texts in pieces of at most 32 MB.
    chunk, = chunks(pa.array([""] * 10_000))
    pieces = list(language.parts(chunk, 4_314))
    assert sum(p.high - p.low for p in pieces) == 10_000
    assert max(language._presence(p, model.column, 4_314).nbytes for p in pieces) <= 1 << 25


def test_parts_of_a_chunk_are_its_rows(monkeypatch):
    monkeypatch.setattr(language, "MOST_ENTRIES", 20)
    texts = ["ab", "", "cde", "f", "", "gh"]
    chunk, = chunks(pa.array(texts))
    pieces = list(language.parts(chunk, 10))
    assert [p.high - p.low for p in pieces] == [2, 2, 2]
    said = [bytes(p.data[a:b]).decode() for p in pieces for a, b in zip(p.offsets[:-1], p.offsets[1:])]
    assert said == texts
