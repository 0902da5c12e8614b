"""The corpus pipeline: quality rules, line de-duplication, SimHash, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, line_dedup, packing, quality_rules, simhash
from quillspark.llm.common import staged

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.filter_documents),
    ("line_dedup", line_dedup.clean_documents),
    ("simhash", simhash.keep_one),
    ("decontamination", decontamination.drop_contaminated),
    ("packing", packing.pack_documents),
]

#: The stages learn rules, cluster and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each reads what the one before wrote as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
