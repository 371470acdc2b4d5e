"""The five stages on a small fixture, stage by stage and as a whole."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = [f"word{k}" for k in range(60)]
    item = "Which river runs through the old town of Barrow near the stone bridge today? The river is called the little Wenning and it is short."
    texts = [" ".join(words), " ".join([*words[:58], "x", "y"]), "123 456", None, item, "a clean text that nothing else is like at all\nand its second line"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "bpe"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 5]
    assert all(r["n_tokens"] > 0 for r in got)
