"""Registered queries that run whole hybrid and structured searches over the derived tables, and their SQL.

Ranks decide the scores here (no reranker), so that SQL need not cut chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.query_language import parse_document
from ..operators import fulltext as ft
from ..operators import nearest
from ..operators.provider import MockProvider
from ..sources import derived
from . import hybrid
from .lexical import search_sql
from .vectors import knn_sql

#: Components of the table's vectors.
DIMENSIONS = 64
SEARCHES = [(1, "the tion"), (2, "de la"), (3, "erst nicht"), (4, "the")]
DOCUMENT = "lex: the\nvec: rivers and boats\nhyde: boats float on the river"
COLLECTIONS = ("src1", "src3")
LIMIT = 10


def _parts(spark, sf_dir):
    docs, vectors, provider = derived.documents(spark, sf_dir), derived.chunk_vectors(spark, sf_dir), MockProvider(DIMENSIONS)

    def lexical(texts, limit, collection=None):
        return ft.search(spark, docs, texts, limit=limit, collection=collection)

    def semantic(texts, limit, collection=None):
        asked = spark.createDataFrame(texts, "query_id int, text string").select("query_id", provider.embed(F.col("text")).alias("query_vec"))
        return nearest.knn(vectors, docs, asked, limit, collection)

    cache = spark.createDataFrame([], "hash string, result string, created_at string")
    return lexical, semantic, docs, cache, provider


def hybrid_search(spark, sf_dir):
    """A batch of hybrid searches: probe, strong signal, expansions, lists of both kinds, fusion, limit."""
    queries = [hybrid.read_query(i, text)[0] for i, text in SEARCHES]
    out = hybrid.hybrid(spark, queries, *_parts(spark, sf_dir), limit=LIMIT, rerank=False)
    return out.select("query_id", "final_rank", "doc_id", "file", "blended")


def structured_search(spark, sf_dir):
    """The search that a query document spells out, over two collections."""
    out = hybrid.structured(spark, 1, parse_document(DOCUMENT), *_parts(spark, sf_dir), collections=list(COLLECTIONS), limit=LIMIT, rerank=False)
    return out.select("query_id", "final_rank", "doc_id", "file", "blended")


def _digit(place: str) -> str:
    return f"(strpos('0123456789abcdef', substr(sha256(text), {place}, 1)) - 1)"


def _asked(rows: list[tuple[int, str]]) -> str:
    """The query vectors of (id, text), as the provider makes them."""
    values = ", ".join(f"({i}, '{t}')" for i, t in rows)
    byte = f"16 * {_digit('2 * (i % 32) + 1')} + {_digit('2 * (i % 32) + 2')}"
    return f"asked AS (SELECT id AS vec_id, list_transform(range({DIMENSIONS}), lambda i: CAST(({byte}) / 128.0 - 1 AS FLOAT)) AS embedding FROM (VALUES {values}) t(id, text))"


_FUSED = f"""f AS (SELECT query_id, file, sum(weight / (60 + rank)) AS base, min(rank) AS top FROM l GROUP BY ALL),
g AS (SELECT query_id, file, round(base + CASE WHEN top = 1 THEN 0.05::DOUBLE WHEN top <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END, 9) AS score FROM f),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS INT) AS rank FROM g), {derived.SQL}
SELECT r.query_id, r.rank AS final_rank, docs.doc_id, r.file, round(1.0::DOUBLE / r.rank, 9) AS blended FROM r JOIN docs ON r.file = '{derived.SCHEME}://' || collection || '/' || path WHERE r.rank <= {LIMIT}"""


def _hybrid_sql() -> str:
    # query q's own text is asked as 10 q, its expansions as 10 q + 1 and 10 q + 2
    forms = [(10 * q + n, lead + text) for q, text in SEARCHES for n, lead in enumerate(("", "doc about ", "semantic "))]
    return f"""WITH {_asked(forms)}, lex AS ({search_sql(SEARCHES, limit=hybrid.PROBE)}), kn AS ({knn_sql(hybrid.PROBE, asked='asked q')}),
s AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM lex WHERE rank <= 2 GROUP BY 1),
strong AS (SELECT query_id FROM s WHERE top >= 0.85 AND round(top - second, 6) >= 0.15),
l AS (SELECT query_id, file, rank, 2.0::DOUBLE AS weight FROM lex
  UNION ALL SELECT query_id // 10, file, rank, CASE WHEN query_id % 10 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END FROM kn WHERE query_id % 10 = 0 OR query_id // 10 NOT IN (SELECT query_id FROM strong)),
{_FUSED}"""


def _structured_sql() -> str:
    searches, n = parse_document(DOCUMENT).searches, len(COLLECTIONS)
    words, meanings = ([t for k, t, _ in searches if (k == "lex") == w] for w in (True, False))
    lists = []
    for i, c in enumerate(COLLECTIONS):
        lists.append(f"SELECT query_id + {i * len(words)} AS list_index, file, rank FROM ({search_sql(list(enumerate(words)), limit=hybrid.PROBE, collection=c)})")
        lists.append(f"SELECT query_id + {n * len(words) + i * len(meanings)}, file, rank FROM ({knn_sql(hybrid.PROBE, c, asked='asked q')})")
    return f"""WITH {_asked(list(enumerate(meanings)))}, l0 AS ({' UNION ALL '.join(lists)}),
l AS (SELECT 1 AS query_id, file, rank, CASE WHEN list_index = (SELECT min(list_index) FROM l0) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM l0),
{_FUSED}"""


def queries() -> dict:
    return {"hybrid_search": hybrid_search, "structured_search": structured_search}


def oracle_sql() -> dict[str, str]:
    return {"hybrid_search": _hybrid_sql(), "structured_search": _structured_sql()}
