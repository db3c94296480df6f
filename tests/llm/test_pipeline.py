import corpus_pipeline


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in packed}
    assert ids < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(ids) > 0.6 * docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
