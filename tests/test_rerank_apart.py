"""Reranking of texts that are moved once, against the form that carries them with every query."""

import re

from pyspark.sql import functions as F

from quillspark.operators import provider
from quillspark.operators.provider import MockProvider
from quillspark.plans import documents


def test_texts_stay_out_of_candidates(spark, tmp_path):
    texts = [(1, "alpha beta"), (2, "gamma"), (3, "alpha beta"), (4, ""), (5, "delta alpha")]
    chunks = spark.createDataFrame(texts, "doc_id long, chunk string")
    asked = spark.createDataFrame([("alpha",), ("beta gamma",)], "query string")
    key = provider.cache_key("rerank", query=F.col("query"), model=F.lit(provider.RERANK_MODEL), chunk=F.col("chunk"))
    rows = chunks.crossJoin(asked)
    cache = rows.where("doc_id = 2").select(key.alias("key"), F.lit("0.25").alias("result"))
    got = provider.rerank_apart(rows.withColumn("key", key).drop("chunk"), chunks, cache, MockProvider())
    want = provider.rerank_cached(rows, cache, MockProvider())
    pick = lambda frame: sorted(map(tuple, frame.select("doc_id", "query", "rerank", "cached").collect()))
    assert pick(got) == pick(want) and len(pick(got)) == 10


def test_registered_query_moves_a_text_once(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(k, f"text {k % 7} of words") for k in range(40)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, f"text words {k} more") for k in range(0, 100)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = documents.rerank_cached(spark, d)
    assert out.count() == 40 * 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"chunk#\d+ AS|AS chunk#", plan)) <= 1, plan
