import corpus_pipeline
from braidline.runtime import cut

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns
        assert docs.count() <= n
        n = docs.count()
        assert n == docs.select("doc_id").distinct().count(), name
    assert docs.where("text rlike '[a-z0-9.]+@mail[0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = " ".join(["the of and to in that"] + [f"word{i} and the" for i in range(40)])
    rows = [(1, long, "en", "s", 3), (1, long, "en", "s", 3), (2, None, None, None, None), (None, long + " tail", "xx", "s", 1), (3, "", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF))
