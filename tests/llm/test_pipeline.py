import corpus_pipeline
import __spark_entry__ as entry


def test_stages_keep_the_columns_and_follow_each_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    ids = docs.groupBy("doc_id").count()
    assert ids.where("count > 3").count() == 0


def test_all_text_queries_are_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names
