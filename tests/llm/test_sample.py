from __future__ import annotations

from pyspark.sql import functions as F

from lakewarden.llm.linear import sampled


def test_sample_takes_all_of_8000_labelled_documents(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    assert len(sampled(docs.filter("doc_id < 7000"), labels.filter("doc_id < 7000"), ["toxic"])) == 7000
    assert len(sampled(docs, labels, ["toxic"])) == 8000
