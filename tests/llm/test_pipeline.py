import corpus_pipeline
from corvane.llm import decontaminate, minhash, secret_scan, toxicity
from tests.llm.helpers import rows


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].columns == docs.columns
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = dict(rows(toxicity.score_toxicity(docs, labels), "doc_id", "predicted"))
    assert {r.doc_id for r in kept[1].collect()} == {i for i, p in scored.items() if not p}
    near = minhash.near_duplicates(kept[1]).where("kept")
    assert rows(kept[2], "doc_id") == rows(near, "doc_id")
    bad = {r.doc_id for r in decontaminate.contaminated(kept[2], bench).collect()}
    assert {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - bad
    assert rows(kept[4], "doc_id") == rows(kept[3], "doc_id")
    assert all(not secret_scan.base_spans(r.text or "") for r in kept[4].collect())
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept[4].collect()}


def test_dedup_edge_cases(spark):
    from tests.llm.helpers import documents

    texts = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (5, None), (6, None), (7, ""), (8, "x y"), (9, "X y")]
    docs = documents(spark, texts, extra=True)
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert rows(got, "doc_id") == sorted([(1,), (None,), (5,), (6,), (7,), (8,)], key=str)
    assert minhash.deduplicated(docs.limit(0)).count() == 0
