"""Retrieval quality: hits, precision, recall, reciprocal rank, F1, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.derived import SCHEME


def normalize_path(p: Column) -> Column:
    """Lower case, without the scheme and collection of a virtual path and slashes at the ends."""
    rest = F.regexp_replace(p, f"^{SCHEME}://(?:[^/]*/)?", "")
    return F.regexp_replace(F.lower(F.when(p.startswith(f"{SCHEME}://"), rest).otherwise(p)), "^/+|/+$", "")


def paths_match(a: Column, b: Column) -> Column:
    x, y = normalize_path(a), normalize_path(b)
    return x.endswith(y) | y.endswith(x)


def score(results: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Metrics of results (keys, rank, file) against expected (keys, file, top_k), one row for each group of keys that expects anything."""
    e = expected.withColumnRenamed("file", "want")
    pairs = e.join(results, list(keys), "left").where(F.col("file").isNull() | paths_match(F.col("file"), F.col("want")))
    best = e.join(pairs.groupBy(*keys, "want").agg(F.min("rank").alias("rank")), [*keys, "want"], "left")
    within = lambda k: F.count_if(F.col("rank") <= k)
    out = best.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("top_k").alias("k"), F.count_if(F.col("rank") <= F.col("top_k")).alias("hits_at_k"), F.count("rank").alias("found"), F.min("rank").alias("first"),
        within(1).alias("h1"), within(3).alias("h3"), within(5).alias("h5"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rank").isNull(), F.col("want")))), ",").alias("unmatched"),
    )
    r6 = lambda c: F.round(c, 6)
    p, r = F.col("hits_at_k") / F.least("k", "n"), F.col("found") / F.col("n")
    return out.select(*keys, "hits_at_k", r6(p).alias("precision_at_k"), r6(r).alias("recall"), r6(F.col("h1") / F.col("n")).alias("recall_at_1"), r6(F.col("h3") / F.col("n")).alias("recall_at_3"), r6(F.col("h5") / F.col("n")).alias("recall_at_5"),
                      r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), r6(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"), "unmatched")


def summary(scores: DataFrame, by: str) -> DataFrame:
    names = ("precision_at_k", "recall", "mrr", "f1")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count("*")  # noqa: E731  exact sums: no order of rows shows
    return scores.groupBy(by).agg(F.count("*").alias("queries"), *[F.round(mean(c), 6).alias(f"avg_{c}") for c in names])


def hit_rates(scores: DataFrame, by: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)), 6)
    return scores.groupBy(by).agg(rate("recall_at_1").alias("hit_at_1"), rate("recall_at_3").alias("hit_at_3"), rate("recall_at_5").alias("hit_at_5"))
