"""The pipeline's stages one by one, on a small fixture."""

import corpus_pipeline

from lexigraph.llm import near_duplicates


def test_stages(spark, tmp_path):
    base = "The road was long and quiet, and it had rained on the hills for days before we came."
    good = [f"{base} Then {i} of us walked on, number {i * 7}, past farm {i * 13} and over bridge {i * 29}." for i in range(12)]
    leak = "Seven grey herons stood along the canal while the miller counted sacks of barley in the early light of morning"
    texts = good + [good[3]] + [f"BUY{i}!! NOW!! $$$ ### " * 9 for i in range(12)] + [f"We heard a story. {leak}. It was an old one, they said, and nobody knew where it began."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 13 or i == 25), 0) for i in range(26)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[k] = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert k == 4 or at.columns == docs.columns
    assert kept[0] == set(range(13)) | {25}
    assert 12 not in kept[1] and kept[2] == kept[1] and kept[3] == kept[2] - {25} and kept[4] == kept[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_near_duplicate_stage_makes_no_row_for_a_pair_of_a_large_cluster(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 8)
    rows, stored = {}, near_duplicates.stored

    def counted(df, label):
        rows[label] = (out := stored(df, label)).count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words)] + [" ".join(w if k != i else f"x{i}" for k, w in enumerate(words)) for i in range(60)] + ["another text that is like none of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {0, 61}
    assert rows["near-pairs"] < 300 and rows["near-links"] < 300
