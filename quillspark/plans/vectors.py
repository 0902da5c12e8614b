"""Registered queries of vector search and fusion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine_distance
from ..operators import fusion, nearest, pivots
from ..operators.provider import MockProvider
from ..sources import derived
from ..sources.tables import read_table
from .lexical import search_sql

#: The queries: every row whose id is divisible by 20.
ASKED = "vec_id % 20 = 0"


def asked_vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


_DIST = "CASE WHEN len(e.embedding) <> len(q.embedding) OR len(e.embedding) = 0 THEN 'inf'::DOUBLE ELSE round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) END"
_ALL = f"embeddings q WHERE q.{ASKED}"


def _vecs(asked: str = _ALL) -> str:
    return f"""{derived.SQL},
dist AS (SELECT q.vec_id AS query_id, e.*, {_DIST} AS distance FROM vecs e, {asked})"""


_VECS = _vecs()


def knn_sql(limit: int, collection: str | None = None, asked: str = _ALL) -> str:
    """``asked`` names the table q of query vectors (vec_id, embedding)."""
    k = max(1, min(3 * limit, 1000))
    only = f"AND collection = '{collection}'" if collection else ""
    return f"""WITH {_vecs(asked)},
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {k}),
hits AS (SELECT n.query_id, n.vec_id, n.pos, n.distance, d.doc_id, d.collection, d.path, '{derived.SCHEME}://' || d.collection || '/' || d.path AS file
  FROM near n JOIN docs d USING (doc_id) WHERE d.active {only} QUALIFY row_number() OVER (PARTITION BY n.query_id, d.doc_id ORDER BY n.distance, n.vec_id) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, file) AS INT) AS rank, doc_id, collection, path, file, pos, distance, round(1 - distance, 6) AS score
FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, file) <= {limit}"""


def _knn(limit, collection=None):
    return lambda s, d: nearest.knn(derived.chunk_vectors(s, d), derived.documents(s, d), asked_vectors(s, d), limit, collection)


def by_pivots(spark, sf_dir):
    """The ten nearest vectors by pivots and rings; most of the others are never compared."""
    vectors = derived.chunk_vectors(spark, sf_dir).select("vec_id", "doc_id", "seq", "embedding")
    out = pivots.nearest_k(spark, pivots.build(vectors), asked_vectors(spark, sf_dir), 10)
    if out is None:
        out = vectors.limit(0).select("*", F.col("vec_id").alias("query_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("r"))
    return out.select("query_id", F.col("r").alias("rank"), "vec_id", "doc_id", "seq", "distance")


def all_distances(spark, sf_dir):
    return nearest.distances(derived.chunk_vectors(spark, sf_dir).select("vec_id", "embedding"), asked_vectors(spark, sf_dir)).select("query_id", "vec_id", "distance")


def multi_query(spark, sf_dir):
    hits = _knn(10)(spark, sf_dir).withColumn("search_id", (F.col("query_id") % 2).cast("int"))
    return nearest.merged_by_file(hits, 10, 0.05).select("search_id", "rank", "file", "score")


def stored_vector(spark, sf_dir):
    v = derived.chunk_vectors(spark, sf_dir).join(derived.documents(spark, sf_dir).select("doc_id", "hash"), "doc_id")
    return v.select(F.concat("hash", F.lit("_"), F.col("seq").cast("string")).alias("hash_seq"), F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def distance_guards(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    inf = lambda c: F.when(c == float("inf"), "inf").otherwise(F.round(c, 6).cast("string")) == "inf"
    return e.select("vec_id", inf(cosine_distance(F.col("embedding"), zero)).alias("zero_norm"), inf(cosine_distance(F.col("embedding"), F.slice("embedding", 1, 3))).alias("mismatch"), (F.round(cosine_distance(F.col("embedding"), F.col("embedding")), 6) == 0).alias("same_is_zero"))


# Ranked lists for fusion: documents of a language, by length, by hash, and by id backwards.
def _lists(spark, sf_dir):
    d = derived.documents(spark, sf_dir).where("active").withColumn("query_id", F.split_part("path", F.lit("/"), F.lit(1)))
    d = d.select("query_id", "doc_id", "collection", F.concat("collection", F.lit("/"), "path").alias("file"), F.length("body").alias("size"), "hash")
    parts = []
    for i, (order, source) in enumerate(((F.desc("size"), "fts"), (F.asc("hash"), "vec"), (F.desc("doc_id"), "vec"))):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id"))
        parts.append(d.withColumn("rank", rank).where("rank <= 30").select("query_id", F.lit(i).alias("list_index"), F.lit(source).alias("source"), "file", "doc_id", "rank", (F.lit(i) != 2).alias("is_original"), F.round(1 / (1 + F.col("rank")), 6).alias("backend_score")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("weight", fusion.hybrid_weight(F.col("is_original")))


_LISTS = derived.SQL + """,
d0 AS (SELECT split_part(path, '/', 1) AS query_id, doc_id, collection || '/' || path AS file, length(body) AS size, hash FROM docs WHERE active),
lists AS (
  SELECT query_id, 0 AS list_index, 'fts' AS source, file, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, doc_id) AS rank, 2.0::DOUBLE AS weight FROM d0
  UNION ALL SELECT query_id, 1, 'vec', file, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hash, doc_id), 2.0::DOUBLE FROM d0
  UNION ALL SELECT query_id, 2, 'vec', file, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC), 1.0::DOUBLE FROM d0),
l30 AS (SELECT *, round(1.0::DOUBLE / (1 + rank), 6) AS backend_score FROM lists WHERE rank <= 30),
fused0 AS (SELECT query_id, file, min(doc_id) AS doc_id, sum(weight / (60 + rank)) AS base, CAST(min(rank) AS INT) AS top_rank FROM l30 GROUP BY ALL),
fused1 AS (SELECT *, CASE WHEN top_rank = 1 THEN 0.05::DOUBLE WHEN top_rank <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END AS bonus FROM fused0),
fused AS (SELECT query_id, file, doc_id, round(base, 9) AS base, top_rank, bonus, round(base + bonus, 9) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(base + bonus, 9) DESC, file) AS INT) AS rank FROM fused1)"""


def _fused(spark, sf_dir):
    return fusion.fuse(_lists(spark, sf_dir))


def rrf_trace(spark, sf_dir):
    t = fusion.trace(_lists(spark, sf_dir)).select("query_id", "file", F.posexplode("contributions").alias("n", "c"))
    return t.select("query_id", "file", "n", "c.list_index", "c.source", "c.rank", "c.weight", "c.backend_score", "c.contribution")


def explain_scores(spark, sf_dir):
    t = fusion.trace(_lists(spark, sf_dir))
    part = lambda kind: F.array_join(F.transform(F.filter("contributions", lambda c: c["source"] == kind), lambda c: c["rank"].cast("string")), ",")
    return t.select("query_id", "file", part("fts").alias("fts_ranks"), part("vec").alias("vec_ranks"), F.size("contributions").alias("n_lists"))


def weights_structured(spark, sf_dir):
    lists = _lists(spark, sf_dir).where((F.col("query_id") != "fr") | (F.col("list_index") > 0))
    return fusion.structured_weights(lists)


def _reranked(spark, sf_dir):
    d = derived.documents(spark, sf_dir).select(F.concat("collection", F.lit("/"), "path").alias("file"), F.col("body"))
    top = _fused(spark, sf_dir).where(F.col("rank") <= fusion.CANDIDATES).join(d, "file")
    return top.withColumn("rerank", MockProvider().rerank(F.lit("the des que und"), F.col("body")))


_RERANK = "(contains(lower(body), 'the')::INT + contains(lower(body), 'des')::INT + contains(lower(body), 'que')::INT + contains(lower(body), 'und')::INT)::DOUBLE / 4"
_RANKED = f"{_LISTS}, rr AS (SELECT f.*, {_RERANK} AS rerank FROM fused f JOIN docs d ON f.file = d.collection || '/' || d.path WHERE rank <= 40)"
_BLEND = "CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"


def blend_position_aware(spark, sf_dir):
    return fusion.blend(_reranked(spark, sf_dir)).select("query_id", "file", "rank", "rerank", "blended")


def strong_signal(spark, sf_dir):
    from ..operators import fulltext as ft

    hits = ft.search(spark, derived.documents(spark, sf_dir), STRONG)
    return fusion.strong_signal(hits)


STRONG = [(1, "the"), (2, "src3"), (3, '"de la"'), (4, "erst nicht")]


def final_dedupe_limit(spark, sf_dir):
    lists = _lists(spark, sf_dir).withColumnRenamed("backend_score", "score")
    return fusion.final(lists, 15, 0.05).select("query_id", "file", "score", "final_rank")


def queries() -> dict:
    return {
        "cosine_distance": all_distances, "cosine_guards": distance_guards, "knn_pivots": by_pivots, "knn_top_k": _knn(10), "knn_dedupe_by_file": _knn(50), "knn_collection_filter": _knn(20, "src3"),
        "nearest_vector": lambda s, d: nearest.nearest(derived.chunk_vectors(s, d), asked_vectors(s, d)), "vector_multi_query_max": multi_query, "stored_vector_lookup": stored_vector,
        "rrf_fuse": lambda s, d: _fused(s, d), "rrf_trace": rrf_trace, "rrf_weights_hybrid": lambda s, d: _lists(s, d).select("query_id", "list_index", "weight").distinct(),
        "rrf_weights_structured": weights_structured, "strong_signal": strong_signal, "blend_position_aware": blend_position_aware,
        "skip_rerank_scores": lambda s, d: _fused(s, d).where("rank <= 40").select("query_id", "file", F.round(1.0 / F.col("rank"), 9).alias("score")),
        "explain_scores": explain_scores, "final_dedupe_limit": final_dedupe_limit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "cosine_distance": f"WITH {_VECS} SELECT query_id, vec_id, distance FROM dist",
        "cosine_guards": "SELECT vec_id, true AS zero_norm, true AS mismatch, true AS same_is_zero FROM embeddings",
        "knn_pivots": f"""WITH {_VECS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, doc_id, seq, distance
FROM dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""",
        "knn_top_k": knn_sql(10), "knn_dedupe_by_file": knn_sql(50), "knn_collection_filter": knn_sql(20, "src3"),
        "nearest_vector": f"WITH {_VECS} SELECT query_id, vec_id, distance FROM dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) = 1",
        "vector_multi_query_max": f"""WITH h AS ({knn_sql(10)}), m AS (SELECT CAST(query_id % 2 AS INT) AS search_id, file, max(score) AS score FROM h GROUP BY ALL HAVING max(score) >= 0.05)
SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, file) AS INT) AS rank, file, score FROM m QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY score DESC, file) <= 10""",
        "stored_vector_lookup": f"WITH {derived.SQL} SELECT hash || '_' || seq AS hash_seq, CAST(len(embedding) AS INT) AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM vecs JOIN docs USING (doc_id)",
        "rrf_fuse": f"WITH {_LISTS} SELECT query_id, file, base, top_rank, bonus, score, rank FROM fused",
        "rrf_trace": f"""WITH {_LISTS} SELECT query_id, file, CAST(row_number() OVER (PARTITION BY query_id, file ORDER BY list_index) - 1 AS INT) AS n, list_index, source, CAST(rank AS INT) AS rank, weight, backend_score,
  round(weight / (60 + rank), 9) AS contribution FROM l30""",
        "rrf_weights_hybrid": f"WITH {_LISTS} SELECT DISTINCT query_id, list_index, weight FROM l30",
        "rrf_weights_structured": f"""WITH {_LISTS}, p AS (SELECT DISTINCT query_id, list_index FROM l30 WHERE query_id <> 'fr' OR list_index > 0)
SELECT query_id, list_index, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY list_index) = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p""",
        "strong_signal": f"""WITH h AS ({search_sql(STRONG)}), s AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM h WHERE rank <= 2 GROUP BY 1)
SELECT *, top >= 0.85 AND round(top - second, 6) >= 0.15 AS strong FROM s""",
        "blend_position_aware": f"WITH {_RANKED} SELECT query_id, file, rank, rerank, round({_BLEND} * (1.0::DOUBLE / rank) + (1 - {_BLEND}) * rerank, 9) AS blended FROM rr",
        "skip_rerank_scores": f"WITH {_LISTS} SELECT query_id, file, round(1.0::DOUBLE / rank, 9) AS score FROM fused WHERE rank <= 40",
        "explain_scores": f"""WITH {_LISTS} SELECT query_id, file, coalesce(string_agg(CASE WHEN source = 'fts' THEN CAST(rank AS VARCHAR) END, ',' ORDER BY list_index), '') AS fts_ranks,
  coalesce(string_agg(CASE WHEN source = 'vec' THEN CAST(rank AS VARCHAR) END, ',' ORDER BY list_index), '') AS vec_ranks, CAST(count(*) AS INT) AS n_lists FROM l30 GROUP BY ALL""",
        "final_dedupe_limit": f"""WITH {_LISTS}, b AS (SELECT query_id, file, max(backend_score) AS score FROM l30 GROUP BY ALL HAVING max(backend_score) >= 0.05)
SELECT query_id, file, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS INT) AS final_rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) <= 15""",
    }
