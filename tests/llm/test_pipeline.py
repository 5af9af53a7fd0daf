import brute

import corpus_pipeline


def test_each_stage_equals_brute_force(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{tiny_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, tiny_dir), name)
        assert docs.columns == columns
        if name == "language_id":
            want = set(texts)  # all of them are in a known language
        elif name == "exact_dedup":
            first = {}
            for d in sorted(texts):
                first.setdefault(brute.normal(texts[d]), d)
            want = set(first.values())
        elif name == "near_dedup":
            want = set(brute.near_classes(texts).values())
        else:
            want = {d for d, t in texts.items() if not any(brute.holds(t, item) for item in items)}
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert sorted(got) == sorted(want)
        texts = {d: texts[d] for d in want}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny_dir).collect()
    assert {r["doc_id"]: r["text"] for r in mixed} == texts
    assert len({(r["mix_slot"], r["mix_at"]) for r in mixed}) == len(texts)
