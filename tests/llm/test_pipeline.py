"""The pipeline: each stage on its own input."""

import corpus_pipeline
from test_operators import brute_groups, brute_overlap

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else None)
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or stage is corpus_pipeline.encoded
        docs = docs.cache()
    ids = {r["doc_id"] for r in docs.collect()}
    benchmark = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {*inputs[3]} == {i for i, c in brute_groups(inputs[2]).items() if i == c}
    assert {*inputs[4]} == {i for i, x in brute_overlap(inputs[3], benchmark).items() if not x[1]} == ids
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i in inputs[2] for i, q in labels.items() if q]
    assert sum(good) > 0.95 * len(good) and len(inputs[1]) > 0.97 * len(inputs[0])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids
