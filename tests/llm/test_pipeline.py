"""The pipeline's stages on a small table: their order, what goes, and what the last one returns."""

import corpus_pipeline
from driftloom.llm import queries


def test_stages(spark, tmp_path):
    docs, labels = [], []
    for i in range(150):
        text = " ".join(f"word{(i * 7 + k * (i % 11 + 1)) % 97}x{k % 13}" for k in range(60))
        docs.append((i, text + " $$$ " * 40 if i % 5 == 0 else text, "en", "s", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs += [(500, docs[1][1], "en", "s", 1), (501, docs[2][1] + " " + passage, "en", "s", 1), (502, docs[3][1] + " again password=abcdefgh12345", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {r["doc_id"]: r.asDict() for r in now.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
    names = list(seen)
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    good = seen[names[0]]
    assert len([i for i in good if i < 150 and i % 5]) >= 115 and len([i for i in good if i < 150 and i % 5 == 0]) <= 2
    assert 500 not in seen[names[1]] and 1 in seen[names[1]]
    # on all documents, whatever the stages before kept
    every = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r["doc_id"]: r["text"] for r in every.collect()}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_benchmark(spark, every, str(tmp_path)).collect()}
    assert cut.keys() == before.keys() and passage not in cut[501] and {i for i in cut if cut[i] != before[i]} == {501}
    hidden = {r["doc_id"]: r["text"] for r in corpus_pipeline.hide_secrets(spark, every, str(tmp_path)).collect()}
    assert hidden[502].endswith("again [SECRET]") and {i for i in hidden if hidden[i] != before[i]} == {502}
    assert seen[names[4]].keys() == seen[names[3]].keys() and all(r["n_tokens"] == len(r["ids"]) for r in seen[names[4]].values())


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {k.split("_")[0] for k in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
