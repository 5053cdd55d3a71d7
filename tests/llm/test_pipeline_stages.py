import corpus_pipeline
from tests.llm.samples import documents


def test_passages_in_kept_documents_are_cut(spark, tmp_path):
    passage = " ".join(f"item{n}" for n in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, after = (" ".join(f"{side}{n}" for n in range(900)) for side in ("a", "z"))
    rows = [(1, f"{before} {passage}. {after}"), (2, f"short {passage} text"), (3, before), (4, None), (5, "")]
    docs = documents(spark, rows)
    kept = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and kept.columns == docs.columns
    found = {row["doc_id"]: row for row in kept.collect()}
    assert {key: row["text"] for key, row in found.items()} == {1: f"{before} . {after}", 3: before, 4: None, 5: ""}
    assert all(row["n_chars"] == (None if row["text"] is None else len(row["text"])) for row in found.values())
