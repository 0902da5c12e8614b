"""Registered queries of full-text retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext as ft
from ..sources import derived
from ..sources.scratch import scratch_path
from ..sources.tables import read_table
from ..functions.query_language import parse_lexical, validate_lexical, validate_semantic
from .index import Index

QUERIES = {
    "bm25_prefix_top20": dict(queries=[(1, "the"), (2, "und"), (3, "que")]),
    "bm25_multi_term_and": dict(queries=[(1, "the of and"), (2, "die der"), (3, "la de")]),
    "bm25_phrase": dict(queries=[(1, '"of the"'), (2, '"de la"'), (3, '"in" an')]),
    "bm25_negation": dict(queries=[(1, 'the -was'), (2, 'des -"de la"'), (3, "en -el -los")]),
    "bm25_hyphen_and_sanitised": dict(queries=[(1, "of-the"), (2, "don't"), (3, "(and)!")]),
    "bm25_collection_overfetch": dict(queries=[(1, "the"), (2, "en")], collection="src3"),
    "bm25_collection_exact": dict(queries=[(1, "the"), (2, "en")], collection="src3", exact=True),
    "bm25_min_score": dict(queries=[(1, "the"), (2, "sch")], min_score=0.2),
}

_FOLD = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"
_CJK = r"regexp_replace({}, '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}])', ' \1 ', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({_FOLD.format(_CJK.format(x))}, '[{T.TOKEN_CLASS}]+')"


TOKENS_SQL = derived.SQL + f""",
cols AS (SELECT doc_id, 'filepath' AS col, {_tokens("collection || '/' || path")} AS terms FROM docs WHERE active
  UNION ALL SELECT doc_id, 'title', {_tokens("title")} FROM docs WHERE active
  UNION ALL SELECT doc_id, 'body', {_tokens("body")} FROM docs WHERE active),
toks AS (SELECT doc_id, col, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM cols)"""


def search_sql(queries, limit=ft.DEFAULT_LIMIT, collection=None, min_score=0.0, exact=False, tokens=TOKENS_SQL) -> str:
    rows = []
    for q, text in queries:
        for i, item in enumerate(parse_lexical(text)):
            for k, t in enumerate(item.tokens or ("\u0000",)):
                rows.append(f"({q}, {i}, {item.negated}, {item.prefix and k == max(0, len(item.tokens) - 1)}, {k}, {max(1, len(item.tokens))}, '{t}')")
    cut = limit * ft.OVERFETCH if collection and not exact else limit
    only = f"AND collection = '{collection}'" if collection else ""
    early = f"WHERE doc_id IN (SELECT doc_id FROM docs WHERE collection = '{collection}')" if collection and exact else ""
    return f"""WITH {tokens},
items(query_id, item, negated, prefix, k, m, token) AS (VALUES {', '.join(rows)}),
base AS (SELECT query_id, item, negated, doc_id, col, pos - k AS base, m, count(DISTINCT k) AS got
  FROM toks JOIN items ON (NOT prefix AND term = token) OR (prefix AND starts_with(term, token)) GROUP BY ALL HAVING count(DISTINCT k) = m),
hits AS (SELECT query_id, item, negated, doc_id, sum(CASE col WHEN 'filepath' THEN 1.5 WHEN 'title' THEN 4.0 ELSE 1.0 END::DOUBLE) AS f FROM base GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1),
stats AS (SELECT (SELECT count(*) FROM docs WHERE active) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM docs WHERE active) AS avgdl),
dfs AS (SELECT query_id, item, count(*) AS df FROM hits WHERE NOT negated GROUP BY ALL),
idf AS (SELECT query_id, item, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf FROM dfs, stats),
need AS (SELECT query_id, count(DISTINCT item) AS need FROM items WHERE NOT negated GROUP BY 1),
ranked AS (SELECT h.query_id, h.doc_id, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS b, count(*) AS got
  FROM hits h JOIN idf USING (query_id, item) JOIN dl USING (doc_id), stats WHERE NOT negated GROUP BY ALL),
good AS (SELECT query_id, doc_id, round(b / (1 + b), 6) AS score FROM ranked JOIN need USING (query_id) WHERE got = need
  AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM hits WHERE negated)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM good {early}),
kept AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, collection, path, title, hash
  FROM top JOIN docs USING (doc_id) WHERE r <= {cut} {only})
SELECT CAST(query_id AS INT) AS query_id, CAST(rank AS INT) AS rank, doc_id, left(hash, 6) AS docid, collection, path, '{derived.SCHEME}://' || collection || '/' || path AS file, title, score
FROM kept WHERE rank <= {limit} AND score >= {min_score}"""


# Every seventh document but for an offset is changed after the index was built.
_CHANGED = "doc_id % 7 = 3"
_NEWER = f"""docs0.doc_id AS doc_id, collection, path, CASE WHEN {_CHANGED} THEN 'Updated ' || CAST(doc_id AS VARCHAR) ELSE title END AS title,
    CASE WHEN {_CHANGED} THEN sha256(body || ' zzfresh the end') ELSE hash END AS hash, CASE WHEN {_CHANGED} THEN body || ' zzfresh the end' ELSE body END AS body, active OR {_CHANGED} AS active"""
UPDATED_SQL = TOKENS_SQL.replace("docs AS (", "docs0 AS (", 1).replace("FROM documents)", f"FROM documents),\ndocs AS (SELECT {_NEWER} FROM docs0)", 1)
STORED = [(1, "the"), (2, "zzfresh"), (3, '"zzfresh the" -und'), (4, "updated"), (5, '"de la"')]


def stored_index(spark, sf_dir) -> Index:
    """An index built of all documents, of which a part is then changed: a small segment over a large one."""
    docs = derived.documents(spark, sf_dir)
    index = Index(spark, scratch_path(spark, "index"), stem=False)

    def build(t) -> None:
        t.replace("documents", docs.withColumn("created_at", F.col("modified_at")))
        t.replace("content", derived.content(spark, sf_dir))
        index._index_texts(t)

    index._change(build)
    index.upsert(docs.where(_CHANGED).select("collection", "path", F.concat(F.lit("Updated "), F.col("doc_id").cast("string")).alias("title"), F.concat("body", F.lit(" zzfresh the end")).alias("body"), F.lit("2030").alias("modified_at")))
    return index


def stored_postings(spark, sf_dir):
    rows = stored_index(spark, sf_dir).table("postings")
    return rows.select("doc_id", "col", "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def _search(**args):
    return lambda spark, sf_dir: ft.search(spark, derived.documents(spark, sf_dir), **args)


def _tokens_of(spark, sf_dir):
    return ft.token_table(derived.documents(spark, sf_dir))


def postings_build(spark, sf_dir):
    out = ft.postings(_tokens_of(spark, sf_dir))
    return out.select("doc_id", "col", "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def multi_collection_postfilter(spark, sf_dir):
    names = F.array(*[F.lit(f"{derived.SCHEME}://{n}/") for n in ("src1", "src2", "src5")])
    out = ft.search(spark, derived.documents(spark, sf_dir), [(1, "the"), (2, "en")], limit=100)
    return out.where(F.exists(names, lambda n: F.col("file").startswith(n)))


def sanitize_terms(spark, sf_dir):
    words = read_table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''").distinct()
    return words.select("item_id", "word", T.sanitize_term(F.col("word")).alias("term"))


def cjk_normalize(spark, sf_dir):
    made = F.concat(F.left("c_name", F.lit(9)), F.lit("日本語テキスト"), F.col("c_custkey").cast("string"), F.lit("한국 mixed漢字end"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", T.normalize_cjk(made).alias("normalized"), T.contains_cjk(made).alias("has_cjk"), T.contains_cjk(F.col("c_name")).alias("plain_has_cjk"))


def query_validation(spark, sf_dir):
    """Both validators over query texts made from the benchmark's words."""
    head = F.substring_index("text", " ", 3)
    forms = F.array(head, F.concat(F.lit('"'), head), F.concat(head, F.lit(" -"), head), F.col("text"), F.concat(F.lit('-"'), head, F.lit('"')))
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(forms).alias("form", "q"))
    bad = F.when(F.col("q").rlike(r'(^|\s)-[\w"]'), validate_semantic("-x"))
    odd = (F.length("q") - F.length(F.replace("q", F.lit('"'), F.lit("")))) % 2 == 1
    lexical = F.when(F.col("q").contains("\n") | F.col("q").contains("\r"), validate_lexical("\n")).when(odd, validate_lexical('"'))
    return rows.select("item_id", "form", lexical.alias("lexical_error"), bad.alias("semantic_error"))


def queries() -> dict:
    out = {name: _search(**args) for name, args in QUERIES.items()}
    return out | {
        "postings_build": postings_build,
        "postings_stored": stored_postings,
        "bm25_stored": lambda s, d: stored_index(s, d).search_lexical(STORED),
        "term_df_stats": lambda s, d: ft.vocabulary(_tokens_of(s, d)),
        "doc_length_stats": lambda s, d: ft.lengths(_tokens_of(s, d)),
        "bm25_multi_collection_postfilter": multi_collection_postfilter,
        "sanitize_term": sanitize_terms,
        "cjk_normalize": cjk_normalize,
        "query_validation": query_validation,
    }


def oracle_sql() -> dict[str, str]:
    out = {name: search_sql(**args) for name, args in QUERIES.items()}
    made = "left(c_name, 9) || '日本語テキスト' || c_custkey || '한국 mixed漢字end'"
    cls = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
    head = "array_to_string(string_split(text, ' ')[1:3], ' ')"
    return out | {
        "postings_build": f"WITH {TOKENS_SQL} SELECT doc_id, col, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM toks GROUP BY ALL",
        "postings_stored": f"WITH {UPDATED_SQL} SELECT doc_id, col, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM toks GROUP BY ALL",
        "bm25_stored": search_sql(STORED, tokens=UPDATED_SQL),
        "term_df_stats": f"WITH {TOKENS_SQL} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM toks GROUP BY 1",
        "doc_length_stats": f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1",
        "bm25_multi_collection_postfilter": f"SELECT * FROM ({search_sql([(1, 'the'), (2, 'en')], limit=100)}) WHERE collection IN ('src1', 'src2', 'src5')",
        "sanitize_term": r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM benchmark)
SELECT item_id, word, lower(regexp_replace(word, '[^\p{L}\p{N}''_]', '', 'g')) AS term FROM w WHERE word <> ''""",
        "cjk_normalize": f"SELECT c_custkey, {_CJK.format(made)} AS normalized, regexp_matches({made}, '{cls}') AS has_cjk, regexp_matches(c_name, '{cls}') AS plain_has_cjk FROM customer",
        "query_validation": f"""WITH f AS (SELECT item_id, [{head}, '"' || {head}, {head} || ' -' || {head}, text, '-"' || {head} || '"'] AS forms FROM benchmark),
r AS (SELECT item_id, unnest(forms) AS q, CAST(generate_subscripts(forms, 1) - 1 AS INT) AS form FROM f)
SELECT item_id, form, CASE WHEN contains(q, chr(10)) OR contains(q, chr(13)) THEN '{validate_lexical(chr(10))}'
  WHEN (length(q) - length(replace(q, '"', ''))) % 2 = 1 THEN '{validate_lexical('"')}' END AS lexical_error,
  CASE WHEN regexp_matches(q, '(^|\\s)-[\\w"]') THEN '{validate_semantic("-x")}' END AS semantic_error FROM r""",
    }
