"""Benchmark fixtures: JSON files of queries and the files each should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY = "struct<id:string,query:string,type:string,description:string,expected_files:array<string>,expected_in_top_k:int>"


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """(collection, id, query, type, description, expected_files, expected_in_top_k): a row a query of the fixtures at ``path``.

    A query without an id, a text or expected files is an error, and so are
    two queries of one id.
    """
    raw = spark.read.schema(f"description string, version int, collection string, queries array<{QUERY}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.select("collection", F.explode("queries").alias("q")).select("collection", "q.*")
    bad = rows.where("id is null or query is null or expected_files is null or expected_in_top_k is null").limit(1).collect()
    if bad:
        raise ValueError(f"a query of the fixture is not whole: {bad[0].asDict()}")
    twice = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the fixture has two queries named {twice[0]['id']}")
    return rows
