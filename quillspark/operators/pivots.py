"""Exact nearest neighbours without a look at every vector: pivots, rings and the triangle inequality.

Vectors are scaled to length one, where the cosine distance is half the square
of the Euclidean one.  Each lies with its nearest pivot, in a ring of those
about as far from it.  How far a query is from a pivot then bounds its
distance to all vectors of a ring from below, so rings are read in the order
of their bounds, and those that can't hold a nearer vector are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, norm
from ..sources.scratch import scratch_path, staged
from .vector_blocks import top_in_rings

#: Pivots, the rows of the bounded sample they are chosen from, and rings a pivot.
PIVOTS, SAMPLE_ROWS, RINGS = 48, 4096, 12
#: Bytes of a row group of vectors.
GROUP_BYTES = 1 << 20
#: Distances are rounded and computed in double precision; bounds give way by so much.
SLACK = 1e-6


def choose_pivots(vectors: DataFrame, many: int = PIVOTS, sample: int = SAMPLE_ROWS) -> list[list[float]]:
    """Up to ``many`` unit vectors far from each other, from a sample of at most ``sample`` rows by hash; each next one is farthest from those before."""
    rows = vectors.where(F.size("embedding") > 0).select("embedding").orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    sizes = {len(r["embedding"]) for r in rows}
    found = []
    for size in sorted(sizes):  # vectors of another length are infinitely far
        points = np.array([r["embedding"] for r in rows if len(r["embedding"]) == size], float)
        lengths = np.linalg.norm(points, axis=1)
        points = points[lengths > 0] / lengths[lengths > 0, None]
        if not len(points):
            continue
        chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < many and far.max() > 1e-9:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        found += points[chosen].tolist()
    return found


def build(vectors: DataFrame, many: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE_ROWS) -> str:
    """Writes ``vectors`` (vec_id, embedding, ..) in the order of pivots and rings; the path.

    Vectors without direction, or of a length that no pivot has, lie with
    pivot -1 and are infinitely far from everything or compared with all.
    """
    spark, pivots = vectors.sparkSession, choose_pivots(vectors, many, sample)
    path = scratch_path(spark, "pivots")
    spark.createDataFrame([(i, p) for i, p in enumerate(pivots)], "pivot int, place array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    # one row with all pivots: as literals they would make the plan as large as the pivots
    all_ = spark.read.parquet(f"{path}/pivots").agg(F.collect_list(F.struct((-F.col("pivot")).alias("i"), F.col("place").alias("p"))).alias("__pivots"))
    same = F.filter("__pivots", lambda p: F.size(p["p"]) == F.size("embedding"))
    nearest = F.array_max(F.transform(same, lambda p: F.struct(dot(F.col("embedding"), p["p"]).alias("d"), p["i"].alias("i"))))
    placed = vectors.withColumn("__n", norm(F.col("embedding"))).crossJoin(F.broadcast(all_)).withColumn("__x", F.when(F.col("__n") > 0, nearest))
    away = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.try_divide(F.col("__x.d"), F.col("__n"))))
    placed = placed.withColumn("pivot", F.coalesce(-F.col("__x.i"), F.lit(-1))).withColumn("away", F.coalesce(away, F.lit(0.0))).drop("__x", "__n", "__pivots")
    placed = staged(placed, "placed")
    limits = placed.groupBy("pivot").agg(F.percentile_approx("away", [k / rings for k in range(1, rings)]).alias("limits"))
    dealt = placed.join(F.broadcast(limits), "pivot").withColumn("ring", F.size(F.filter("limits", lambda x: x < F.col("away")))).drop("limits")
    out = staged(dealt, "dealt")
    out.groupBy("pivot", "ring").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("rows")).write.parquet(f"{path}/rings")
    # sorted, so that a scan skips the row groups of other rings by their limits; a ring of very many rows is spread over files
    out.repartitionByRange("pivot", "ring", "vec_id").sortWithinPartitions("pivot", "ring").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/vectors")
    return path


def _ring_bounds(spark, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, pivot, ring, rows, bound): how near to each query a vector of each ring can be at best, as a Euclidean distance."""
    pivots = spark.read.parquet(f"{path}/pivots")
    rings = spark.read.parquet(f"{path}/rings")  # PIVOTS times RINGS rows
    q = queries.withColumn("__qn", norm(F.col("query_vec")))
    to = q.join(F.broadcast(pivots), F.size("place") == F.size("query_vec"), "left")
    to = to.select("query_id", "pivot", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.try_divide(dot(F.col("query_vec"), F.col("place")), F.col("__qn")))).alias("d"))
    bound = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d")) - SLACK
    near = to.join(F.broadcast(rings), "pivot").select("query_id", "pivot", "ring", "rows", F.coalesce(bound, F.lit(0.0)).alias("bound"))
    odd = queries.select("query_id").crossJoin(F.broadcast(rings.where("pivot = -1")))  # at most RINGS rows
    return near.unionByName(odd.select("query_id", "pivot", "ring", "rows", F.lit(0.0).alias("bound")))


def _scan(spark, path: str, visits: DataFrame, queries: DataFrame, asked: int, k: int) -> DataFrame | None:
    """The ``k`` nearest vectors, and others, of each query in the rings it visits (query_id, pivot, ring, __far), no farther than __far; row groups of rings that nobody visits are skipped."""
    wanted = visits.select("pivot", "ring").distinct().collect()  # PIVOTS times RINGS rows at most
    if not wanted:
        return None
    chosen, by_pivot = F.lit(False), {}
    for r in wanted:
        by_pivot.setdefault(r["pivot"], []).append(r["ring"])
    for pivot, own in by_pivot.items():
        chosen = chosen | ((F.col("pivot") == pivot) & F.col("ring").isin(own))
    sizes = {r["pivot"]: r["n"] for r in spark.read.parquet(f"{path}/rings").groupBy("pivot").agg(F.sum("rows").alias("n")).collect() if r["pivot"] in by_pivot}
    # a query goes to a pivot once, with its rings there
    each = visits.groupBy("query_id", "pivot").agg(F.collect_list("ring").alias("__rings"), F.max("__far").alias("__far")).join(queries, "query_id")
    return top_in_rings(spark.read.parquet(f"{path}/vectors").where(chosen), each, sizes, asked, k)


def nearest_k(spark, path: str, queries: DataFrame, k: int, seen: list | None = None) -> DataFrame | None:
    """The ``k`` nearest vectors of each of ``queries`` (query_id, query_vec), nearest first, then by vec_id: the columns of the vectors, query_id, distance, r; None if there is nothing to compare.

    First each query visits rings by their bounds until they hold k vectors;
    the farthest of its k nearest there then says which other rings it needs.
    ``seen`` gets the share of query and vector pairs that were compared.
    """
    own = staged(queries.select("query_id", "query_vec"), "queries")
    by, asked = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"), own.count()
    bounds = staged(_ring_bounds(spark, path, own), "bounds")
    order = Window.partitionBy("query_id").orderBy("bound", "pivot", "ring")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = staged(bounds.withColumn("before", before).where(F.col("before") < k).select("query_id", "pivot", "ring", "rows", F.lit(None).cast("double").alias("__far")), "visits")
    near = _scan(spark, path, first, own, asked, k)
    if near is None:
        return None
    met = staged(near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k), "met")
    # a cosine distance x is a Euclidean one of sqrt(2x); distances are rounded, so a little more is let in
    reach = met.groupBy("query_id").agg(F.max(F.when(F.col("r") == k, F.col("distance"))).alias("__far")).withColumn("reach", F.sqrt(2 * (F.col("__far") + 1e-9)))
    more = staged(bounds.join(first.select("query_id", "pivot", "ring"), ["query_id", "pivot", "ring"], "left_anti").join(reach, "query_id").where("reach is null or bound <= reach").select("query_id", "pivot", "ring", "rows", "__far"), "visits")
    rest = _scan(spark, path, more, own, asked, k)
    if seen is not None:
        total = bounds.agg(F.sum("rows")).first()[0]
        seen.append((first.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] + more.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], total))
    return met if rest is None else met.drop("r").unionByName(rest).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
