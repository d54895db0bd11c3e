"""The pipeline end to end on the smallest tables: stages keep the columns and their decisions take effect."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_run(spark):
    import corpus_pipeline as P
    from sliceframe.llm import decontaminate, pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = P.run(spark, SF)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() > 0
    assert mixed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    hit = decontaminate.query(mixed.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert hit.where("contaminated").count() == 0
    left = [r.text for r in mixed.select("text").distinct().collect()]
    assert not any(pii.base_spans(t) for t in left)
    total = mixed.agg(F.sum("words")).first()[0]
    sizes = mixed.groupBy("doc_id").agg(F.first("size").alias("s"), F.sum("words").alias("w")).where("w > 2 * s").count()
    assert total > 0 and sizes == 0
