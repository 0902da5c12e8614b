"""Running a fixture's queries through every way to search: metrics, latency, and failures as rows.

All plain queries of a backend are one batch and one plan; query documents of
lex:, vec: and hyde: lines are searched one by one.  A backend that fails has
rows too, with the error and no hits, and the others go on.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.query_language import parse_document
from ..operators import metrics
from ..sources.scratch import staged
from .index import Index

BACKENDS = ("bm25", "vector", "hybrid", "full")
LEAST_LIMIT, TOP_FILES = 10, 10


def _plain(index: Index, backend: str, asked: list[tuple[int, str]], limit: int, collection: str | None) -> DataFrame:
    """(q, rank, file) of a batch of plain queries."""
    if backend == "bm25":
        return index.search_lexical(asked, limit, collection).select(F.col("query_id").alias("q"), "rank", "file")
    if backend == "vector":
        return index.search_vectors(asked, limit, collection).select(F.col("query_id").alias("q"), "rank", "file")
    return index.search(asked, limit, backend == "full", collection=collection).select(F.col("query_id").alias("q"), F.col("final_rank").alias("rank"), "file")


def _document(index: Index, backend: str, n: int, text: str, limit: int, collection: str | None) -> DataFrame:
    """The same of one query document: its own lines only, for the backends that know one kind; each file once, where it comes first."""
    if backend in ("hybrid", "full"):
        hits = index.search_document(text, [collection] if collection else None, limit, backend == "full")
        return hits.select(F.lit(n).alias("q"), F.col("final_rank").alias("rank"), "file")
    kinds = ("lex",) if backend == "bm25" else ("vec", "hyde")
    own = [(i, t) for i, (kind, t, _) in enumerate(parse_document(text).searches) if kind in kinds]
    if not own:
        return index.spark.createDataFrame([], "q int, rank int, file string")
    run = index.search_lexical if backend == "bm25" else index.search_vectors
    first = run(own, limit, collection).groupBy("file").agg(F.min(F.struct("query_id", "rank")).alias("x"))
    return first.select(F.lit(n).alias("q"), F.row_number().over(Window.orderBy("x")).alias("rank"), "file").where(F.col("rank") <= limit)  # a few lines' hits


def run(index: Index, fixture: DataFrame, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """A row for each query of ``fixture`` (of :func:`read_fixture`) and backend: id, type, backend, the metrics, total_expected, latency_ms, error, top_files.

    ``latency_ms`` of a query in a batch is its share of the batch's time.  A
    query that failed has zeros, and the files it should have found unmatched.
    """
    spark, queries = index.spark, fixture.orderBy("id").collect()  # as many as a fixture has
    at, hits, notes = index, None, []
    for backend in backends:
        batches: dict[tuple, list[int]] = {}
        for n, q in enumerate(queries):
            limit = max(q["expected_in_top_k"], LEAST_LIMIT)
            structured = n if parse_document(q["query"]) is not None else None
            batches.setdefault((structured, q["collection"], limit), []).append(n)
        for (structured, collection, limit), own in batches.items():
            began, error = time.monotonic(), None
            try:
                if structured is None:
                    found = _plain(at, backend, [(n, queries[n]["query"]) for n in own], limit, collection)
                else:
                    found = _document(at, backend, structured, queries[structured]["query"], limit, collection)
                found = staged(found.withColumn("backend", F.lit(backend)), "hits")
                hits = found if hits is None else hits.unionByName(found)
            except Exception as e:  # whatever a backend raises is its row's error
                error = str(e).split("\n", 1)[0] or type(e).__name__
            took = 1000 * (time.monotonic() - began) / len(own)
            notes += [(n, backend, took, error) for n in own]
    names = spark.createDataFrame([(n, q["id"], q["type"], q["expected_in_top_k"], q["expected_files"]) for n, q in enumerate(queries)], "q int, id string, type string, top_k int, expected array<string>")
    told = spark.createDataFrame(notes, "q int, backend string, latency_ms double, error string").join(F.broadcast(names), "q")
    wanted = told.select("q", "backend", F.explode("expected").alias("file"), "top_k")
    hits = spark.createDataFrame([], "q int, rank int, file string, backend string") if hits is None else hits
    scores = metrics.score(hits.select("q", "backend", "rank", "file"), wanted, ("q", "backend"))
    top = hits.where(F.col("rank") <= TOP_FILES).groupBy("q", "backend").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("top_files"))
    out = told.join(scores, ["q", "backend"], "left").join(top, ["q", "backend"], "left")
    numbers = ("precision_at_k", "recall", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "f1", "hits_at_k")
    return out.select("id", "type", "backend", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.size("expected").alias("total_expected"), F.round("latency_ms", 3).alias("latency_ms"), "error", F.coalesce("unmatched", F.array_join(F.sort_array("expected"), ",")).alias("unmatched"), F.coalesce("top_files", F.array().cast("array<string>")).alias("top_files"))


def report(rows: DataFrame) -> DataFrame:
    """A row a backend: the means of the metrics, of the latency, and how many queries failed."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("backend").agg(F.count("*").alias("queries"), *[mean(c).alias(f"avg_{c}") for c in ("precision_at_k", "recall", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "f1", "latency_ms")], F.count("error").alias("errors"))
