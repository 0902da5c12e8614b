"""Registered queries of text functions, chunking, model-backed steps, quality metrics and sinks, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import display as V
from ..functions import paths as P
from ..functions import text as T
from ..operators import batching, chunking, fusion, metrics, nearest, sinks
from ..operators import fulltext as ft
from ..operators import provider as pv
from ..sources import derived
from ..sources.scratch import staged
from ..sources.tables import read_table
from . import hybrid
from .lexical import search_sql
from .vectors import ASKED, asked_vectors, knn_sql

D = f"WITH {derived.SQL}"
TICKS = "```"


def _docs(s, d):
    return derived.documents(s, d)


def _made(s, d):
    """Documents with markdown around their text: a heading, sub-headings, a rule, lists and a fence."""
    docs = read_table(s, d, "documents")
    lines = F.split("text", "\n", -1)
    body = F.concat(F.lit("intro\n# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).when(i % 3 == 1, F.concat(F.lit("- "), x)).otherwise(x)), "\n"), F.lit(f"\n---\n{TICKS}py\nx = 1\n\n{TICKS}\n1. one\nend"))
    return docs.select("doc_id", body.alias("body"))


_MADE = f"""made AS (SELECT doc_id, 'intro' || chr(10) || '# Title ' || doc_id || chr(10) || chr(10) || array_to_string([CASE WHEN (i - 1) % 3 = 0 THEN '## ' || x WHEN (i - 1) % 3 = 1 THEN '- ' || x ELSE x END FOR x, i IN string_split(text, chr(10))], chr(10))
  || chr(10) || '---' || chr(10) || '{TICKS}py' || chr(10) || 'x = 1' || chr(10) || chr(10) || '{TICKS}' || chr(10) || '1. one' || chr(10) || 'end' AS body FROM documents),
ln AS (SELECT doc_id, length(body) AS size, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i, len(string_split(body, chr(10))) AS n FROM made),
lp AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS BIGINT) AS pos FROM ln)"""


def titles(s, d):
    docs = _docs(s, d)
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.substring_index("title", " ", 3), F.lit("\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x\n# Notes\n\n## "), F.substring_index("title", " ", 2), F.lit("\n"))).otherwise("")
    return docs.select("doc_id", T.title_of(F.concat(head, F.lit("plain text")), F.col("path")).alias("title"))


def handelized(s, d):
    pages = read_table(s, d, "pages")
    made = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("/My File (v"), (F.col("page_id") % 5).cast("string"), F.lit(")___part two!.MD"))
    return pages.select("page_id", P.handelize(made).alias("path"), P.handelize(F.concat(F.lit("a/"), F.lit("...!"))).alias("nothing"))


def snippets(s, d):
    b = read_table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("the des queda und")).alias("x"))
    return b.select("doc_id", "x.line", "x.snippet", "x.before", "x.after", "x.count", "x.header")


def virtual_paths(s, d):
    v = _docs(s, d).select("doc_id", F.concat(F.lit(f"{derived.SCHEME}://"), "collection", F.lit("//"), "path", F.when(F.col("doc_id") % 2 == 0, "?index=my%20index").otherwise("")).alias("v"))
    return v.select("doc_id", P.parse_virtual_path(F.col("v")).alias("x"), P.is_virtual_path(F.col("v")).alias("is_virtual")).select("doc_id", "x.*", "is_virtual")


def resolve_roots(s, d):
    """The collection whose root is the longest prefix of a file's path."""
    roots = s.createDataFrame([("data", "/data"), ("texts", "/data/texts"), ("english", "/data/texts/en")], "name string, root string")
    files = _docs(s, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "/data/").otherwise("/data/texts/"), "path").alias("file"))
    fit = files.join(F.broadcast(roots), F.col("file").startswith(F.concat("root", F.lit("/"))))
    best = fit.groupBy("doc_id", "file").agg(F.max_by(F.struct("name", "root"), F.length("root")).alias("x"))
    return best.select("doc_id", F.col("x.name").alias("collection"), F.substring("file", F.length("x.root") + 2, F.length("file")).alias("rest"))


#: Parts of paths by the document's id, and where relative ones begin.
CURRENT = "/home/me/./work"


def resolved_paths(s, d):
    """Paths put together from relative and absolute parts, with drives, dot segments and backslashes."""
    docs = _docs(s, d)
    forms = [("/data/texts", "{p}"), ("notes", "../{p}", "./"), ("/x", "C:\\docs\\{l}", "..", "{p}"), ("/d/Work", "../../../{p}"), ("C:/a/b", "/{p}"), ("../../../..", "{l}//x")]
    fill = lambda t: F.concat(*[F.col("path") if x == "{p}" else F.split_part("path", F.lit("/"), F.lit(1)) if x == "{l}" else F.lit(x) for x in re.split(r"(\{[pl]\})", t) if x])
    parts = F.when(F.lit(False), F.array(F.lit("")))
    for i, form in enumerate(forms):
        parts = parts.when(F.col("doc_id") % len(forms) == i, F.array(*map(fill, form)))
    out = P.resolve_path(parts, F.lit(CURRENT))
    return docs.select("doc_id", out.alias("resolved"), P.is_absolute_path(F.col("path")).alias("absolute"), P.relative_to(out, F.lit("/data\\texts/")).alias("under_texts"))


_RESOLVED = """p AS (SELECT doc_id, path, split_part(path, '/', 1) AS l FROM docs),
r AS (SELECT doc_id, path, CASE doc_id % 6 WHEN 2 THEN 'C:' WHEN 3 THEN 'D:' WHEN 4 THEN '' ELSE '' END AS drive,
  CASE doc_id % 6 WHEN 0 THEN '/data/texts/' || path WHEN 1 THEN '/home/me/./work/notes/../' || path || '/./' WHEN 2 THEN '/docs/' || l || '/../' || path
    WHEN 3 THEN '/Work/../../../' || path WHEN 4 THEN '/' || path ELSE '/home/me/./work/../../../../' || l || '//x' END AS rest FROM p),
f AS (SELECT doc_id, path, drive || '/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(rest, '/'), lambda s: [s])),
  lambda acc, s: CASE WHEN s[1] = '..' THEN acc[1:len(acc) - 1] WHEN s[1] IN ('', '.') THEN acc ELSE acc || s END), '/') AS resolved FROM r)"""


def embedding_batches(s, d):
    """The active documents of each collection in batches of at most 64 and 60,000 bytes, in the order of their paths."""
    docs = _docs(s, d).where("active").select("doc_id", "collection", "path", F.octet_length("body").cast("long").alias("bytes"))
    return batching.batches(docs, "collection", ["path"], "bytes", 64, 60_000)


_BATCHES = """o AS (SELECT doc_id, collection, path, CAST(strlen(body) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY collection ORDER BY path) AS i FROM docs WHERE active),
f AS (SELECT collection, i, 0 AS batch, 1 AS n, bytes AS total FROM o WHERE i = 1
  UNION ALL SELECT o.collection, o.i, CASE WHEN n >= 64 OR total + o.bytes > 60000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 64 OR total + o.bytes > 60000 THEN 1 ELSE n + 1 END,
    CASE WHEN n >= 64 OR total + o.bytes > 60000 THEN o.bytes ELSE total + o.bytes END FROM f JOIN o ON o.collection = f.collection AND o.i = f.i + 1)"""


def times(s, d):
    o = read_table(s, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("rfc3339"), F.datediff(F.to_date(F.lit("2030-01-01")), F.to_date("o_orderdate")).cast("int").alias("days"))


def best_chunks(s, d):
    """The best of fixed chunks (a line each) of every document for query and intent words."""
    terms, intent = T.query_terms(F.lit("the ration queda und")), T.intent_terms(F.lit("find the erlich tion"))
    lines = read_table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "chunk"))
    hits = lambda ts: F.size(F.filter(ts, lambda t: F.contains(F.lower("chunk"), t)))
    scored = lines.select("doc_id", "seq", "chunk", (hits(terms) + 0.5 * hits(intent)).alias("score"))
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", -F.col("seq"))).alias("x")).select("doc_id", "x.score", (-F.col("x.col2")).alias("seq"))


def mock_embeddings(s, d):
    v = pv.MockProvider().embed(F.col("text"))
    return read_table(s, d, "benchmark").select("item_id", *[F.round(F.element_at(v, i + 1).cast("double"), 6).alias(f"v{i}") for i in range(4)])


def formatted(s, d):
    b = read_table(s, d, "benchmark")
    model = F.when(F.col("item_id") % 2 == 0, "Qwen3-Embedding").otherwise("other")
    return b.select("item_id", pv.format_query(F.col("text"), model).alias("query"), pv.format_document(F.col("text"), F.when(F.col("item_id") % 3 > 0, F.substring_index("text", " ", 2)), model).alias("document"), pv.fingerprint(model, F.lit("900"), F.col("text")).alias("fingerprint"))


def expansions(s, d):
    b = read_table(s, d, "benchmark").select("item_id", F.lower(F.substring_index("text", " ", 2)).alias("q"), F.substring_index("text", " ", 5).alias("t"))
    answer = F.concat(F.lit("lex: "), "t", F.lit("\nnoise\nvec: about nothing\nhyde:  "), "t", F.lit(": more \nbad: x"))
    out = b.select("item_id", F.posexplode(pv.parse_expansion(answer)).alias("n", "v"))
    return out.select("item_id", "n", "v.type", "v.query")


def fallback(s, d):
    b = read_table(s, d, "benchmark").select("item_id", F.lower(F.substring_index("text", " ", 1)).alias("q"))
    none = F.array(F.struct(F.lit("vec").alias("type"), F.lit("0123").alias("query")))
    return b.select("item_id", F.posexplode(pv.finalize_expansion(none, F.concat("q", F.lit(" zz")))).alias("n", "v")).select("item_id", "n", "v.type", "v.query")


def cache_keys(s, d):
    e = read_table(s, d, "events")
    return e.select("event_id", pv.cache_key("rerank", query=F.col("event_type"), model=F.lit(pv.RERANK_MODEL), chunk=F.concat(F.lit("chunk "), F.col("user_id").cast("string"))).alias("key"))


def rerank_cached(s, d):
    """Every document for the queries of every twentieth item; the cache has the answers for documents of even ids."""
    b = read_table(s, d, "benchmark").where("item_id % 20 = 0").select(F.substring_index("text", " ", 3).alias("query"))
    docs = read_table(s, d, "documents").select("doc_id", F.col("text").alias("chunk"))
    # the stated query set against all rows; keys stand for the texts, which stay where they are
    key = pv.cache_key("rerank", query=F.col("query"), model=F.lit(pv.RERANK_MODEL), chunk=F.col("chunk"))
    rows = staged(docs.crossJoin(F.broadcast(b)).select("doc_id", "query", F.unhex(key).alias("key")), "keyed")
    cache = rows.where("doc_id % 2 = 0").select("key", F.lit("0.5").alias("result")).distinct()
    out = pv.rerank_apart(rows, docs, cache, pv.MockProvider())
    return out.select("doc_id", "query", F.round("rerank", 6).alias("rerank"), "cached")


# Results of two backends for the metrics: by length and by hash; expected: those of quality 1 with the smallest ids.
def _results(s, d):
    docs = _docs(s, d).where("active").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("query_id"), "doc_id", "hash", F.length("body").alias("size"), P.virtual_path(F.col("collection"), F.col("path")).alias("file"))
    part = lambda name, order: docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id"))).where("rank <= 40").select("query_id", F.lit(name).alias("backend"), "rank", "file")
    return part("long", F.desc("size")).unionByName(part("hash", F.asc("hash")))


def _expected(s, d):
    top = _results(s, d).where("rank % 4 = 1").select("query_id", "file").distinct()
    wanted = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("file"))).where("r <= 6").select("query_id", F.when(F.col("r") % 2 == 0, F.upper(F.regexp_replace("file", f"^{derived.SCHEME}://[^/]*/", ""))).otherwise(F.col("file")).alias("file"), F.lit(5).alias("top_k"))
    backends = s.createDataFrame([("long",), ("hash",)], "backend string")
    return wanted.crossJoin(F.broadcast(backends))


def scores(s, d):
    return metrics.score(_results(s, d), _expected(s, d), ("query_id", "backend"))


_NORM = "trim(lower(CASE WHEN starts_with({0}, 'quill://') THEN regexp_replace({0}, '^quill://([^/]*/)?', '') ELSE {0} END), '/')"
_SCORES = f"""{D}, b0 AS (SELECT split_part(path, '/', 1) AS query_id, doc_id, hash, length(body) AS size, 'quill://' || collection || '/' || path AS file FROM docs WHERE active),
r0 AS (SELECT query_id, 'long' AS backend, CAST(row_number() OVER (PARTITION BY query_id ORDER BY size DESC, doc_id) AS INT) AS rank, file FROM b0 UNION ALL SELECT query_id, 'hash', CAST(row_number() OVER (PARTITION BY query_id ORDER BY hash, doc_id) AS INT), file FROM b0),
res AS (SELECT * FROM r0 WHERE rank <= 40),
w0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file) AS r FROM (SELECT DISTINCT query_id, file FROM res WHERE rank % 4 = 1)),
want AS (SELECT query_id, backend, CASE WHEN r % 2 = 0 THEN upper(regexp_replace(file, '^quill://[^/]*/', '')) ELSE file END AS want FROM w0, (VALUES ('long'), ('hash')) t(backend) WHERE r <= 6),
m AS (SELECT w.query_id, w.backend, w.want, (SELECT min(rank) FROM res r WHERE r.query_id = w.query_id AND r.backend = w.backend AND (ends_with({_NORM.format('r.file')}, {_NORM.format('w.want')}) OR ends_with({_NORM.format('w.want')}, {_NORM.format('r.file')}))) AS rank FROM want w),
a AS (SELECT query_id, backend, count(*) AS n, count(*) FILTER (rank <= 5) AS h, count(rank) AS f, min(rank) AS fr, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5,
  coalesce(string_agg(want, ',' ORDER BY want) FILTER (rank IS NULL), '') AS unmatched FROM m GROUP BY ALL),
sc AS (SELECT query_id, backend, h AS hits_at_k, round(h::DOUBLE / least(5, n), 6) AS precision_at_k, round(f::DOUBLE / n, 6) AS recall, round(h1::DOUBLE / n, 6) AS recall_at_1, round(h3::DOUBLE / n, 6) AS recall_at_3, round(h5::DOUBLE / n, 6) AS recall_at_5,
  round(coalesce(1.0::DOUBLE / fr, 0), 6) AS mrr, round(CASE WHEN h + f > 0 THEN 2 * (h::DOUBLE / least(5, n)) * (f::DOUBLE / n) / (h::DOUBLE / least(5, n) + f::DOUBLE / n) ELSE 0 END, 6) AS f1, unmatched FROM a)"""


def _hits(s, d):
    found = ft.search(s, _docs(s, d), [(1, "the"), (2, "de la")], limit=25)
    bodies = _docs(s, d).select("doc_id", "body")
    snip = found.join(bodies, "doc_id").withColumn("x", T.snippet(F.col("body"), F.when(F.col("query_id") == 1, "the").otherwise("de la")))
    return snip.select("query_id", "rank", "docid", "score", "file", "title", F.when(F.col("collection") == "src1", 'first, "one"').alias("context"), F.col("x.line").alias("line"), F.col("x.snippet").alias("snippet"))


def _sink(name):
    return lambda s, d: _hits(s, d).select("query_id", "rank", sinks.FORMATS[name]().alias("value"))


def hybrid_mock(s, d):
    """Hybrid searches by one text and each asked vector; the vector asked before stands for an expansion: lists, fusion, reranking, blending, limit."""
    docs = _docs(s, d)
    text = "the tion"
    asked = asked_vectors(s, d)
    lex = ft.search(s, docs, [(1, text)], limit=20).select(F.lit(0).alias("list_index"), "file", "rank", F.lit(2.0).alias("weight"))
    lex = asked.select("query_id").join(F.broadcast(lex))  # 20 rows
    near = nearest.knn(derived.chunk_vectors(s, d), docs, asked, 20)
    lists = F.array(F.struct(F.col("query_id"), F.lit(1).alias("list_index"), F.lit(2.0).alias("weight")), F.struct((F.col("query_id") + 20).alias("query_id"), F.lit(2).alias("list_index"), F.lit(1.0).alias("weight")))
    vec = near.select(F.explode(lists).alias("x"), "file", "rank").select("x.query_id", "x.list_index", "file", "rank", "x.weight")
    vec = vec.join(asked.select("query_id"), "query_id", "left_semi")
    fused = fusion.fuse(lex.unionByName(vec)).where(F.col("rank") <= fusion.CANDIDATES)
    bodies = docs.select(P.virtual_path(F.col("collection"), F.col("path")).alias("file"), "doc_id", "body")
    ranked = fused.join(bodies, "file").withColumn("rerank", pv.MockProvider().rerank(F.lit(text), F.col("body")))
    return fusion.final(fusion.blend(ranked), 10, score="blended").select("query_id", "final_rank", "doc_id", "file", "blended")


def _hybrid_sql():
    return f"""WITH lex AS ({search_sql([(1, 'the tion')], limit=20)}), kn AS ({knn_sql(20)}), q AS (SELECT vec_id AS query_id FROM embeddings WHERE {ASKED}),
l AS (SELECT q.query_id, file, rank, 2.0::DOUBLE AS weight FROM q, lex UNION ALL SELECT query_id, file, rank, 2.0::DOUBLE FROM kn
  UNION ALL SELECT q.query_id, file, rank, 1.0::DOUBLE FROM kn JOIN q ON q.query_id = kn.query_id + 20),
f AS (SELECT query_id, file, sum(weight / (60 + rank)) AS base, min(rank) AS top FROM l GROUP BY ALL),
g AS (SELECT query_id, file, round(base + CASE WHEN top = 1 THEN 0.05::DOUBLE WHEN top <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END, 9) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS rank FROM g), {derived.SQL},
b AS (SELECT r.query_id, r.file, r.rank, docs.doc_id, (contains(lower(body), 'the')::INT + contains(lower(body), 'tion')::INT)::DOUBLE / 2 AS rr, CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w
  FROM r JOIN docs ON r.file = 'quill://' || collection || '/' || path WHERE rank <= 40),
z AS (SELECT *, round(w * (1.0::DOUBLE / rank) + (1 - w) * rr, 9) AS blended FROM b)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, file) AS INT) AS final_rank, doc_id, file, blended FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, file) <= 10"""


STRUCTURED = ("src1", "src3")


def structured_mock(s, d):
    """Structured searches over two collections by one word and each asked vector: lexical lists first, then vector lists."""
    docs, vectors = _docs(s, d), derived.chunk_vectors(s, d)
    asked = asked_vectors(s, d)
    n, out = len(STRUCTURED), None
    for i, c in enumerate(STRUCTURED):
        lex = ft.search(s, docs, [(1, "the")], limit=20, collection=c).select("file", "rank")
        lex = asked.select("query_id").join(F.broadcast(lex)).select("query_id", F.lit(i).alias("list_index"), "file", "rank")
        vec = nearest.knn(vectors, docs, asked, 20, c).select("query_id", F.lit(n + i).alias("list_index"), "file", "rank")
        out = lex.unionByName(vec) if out is None else out.unionByName(lex).unionByName(vec)
    return fusion.structured(out, 10)


def _structured_sql():
    parts = []
    for i, c in enumerate(STRUCTURED):
        parts.append(f"SELECT q.query_id, {i} AS list_index, file, rank FROM q, ({search_sql([(1, 'the')], limit=20, collection=c)}) x")
        parts.append(f"SELECT query_id, {len(STRUCTURED) + i}, file, rank FROM ({knn_sql(20, c)})")
    return f"""WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE {ASKED}), l AS ({' UNION ALL '.join(parts)}), m AS (SELECT query_id, min(list_index) AS first FROM l GROUP BY 1),
f AS (SELECT query_id, file, round(sum(CASE WHEN list_index = first THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) + CASE WHEN min(rank) = 1 THEN 0.05::DOUBLE WHEN min(rank) <= 3 THEN 0.02::DOUBLE ELSE 0::DOUBLE END, 9) AS s, CAST(min(rank) AS INT) AS top_rank FROM l JOIN m USING (query_id) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, file) AS INT) AS rank FROM f) SELECT query_id, rank, file, top_rank, round(1.0::DOUBLE / rank, 9) AS score FROM r WHERE rank <= 10"""


NOW = 1_750_000_000


def shown_sizes(s, d):
    """Sizes, counts, durations and times of lineitem and orders as people read them."""
    o = read_table(s, d, "orders")
    cents, at = (F.col("o_totalprice") * 100).cast("long"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select("o_orderkey", V.size_text(cents).alias("size"), V.count_text(cents).alias("count"), V.duration_text(F.col("o_orderkey") % 9000).alias("duration"), V.ago_text(at, F.lit(NOW)).alias("ago"), V.listing_time(at, F.lit(NOW)).alias("listed"))


def snippets_with_intent(s, d):
    x = T.extract_snippet(F.col("text"), F.lit("the des queda und"), 1_000_000, intent=F.lit("find the tion, erlich"))
    return read_table(s, d, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.*")


def expanded_queries(s, d):
    """Expansions of the first words of every item; the cache has answers for even items."""
    items = read_table(s, d, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), F.lower(F.substring_index("text", " ", 3)).alias("text"), F.when(F.col("item_id") % 3 == 0, "about words").alias("intent"))
    key = pv.cache_key("expandQuery", query=F.col("text"), model=F.lit(hybrid.EXPAND_MODEL), intent=F.coalesce("intent", F.lit("")))
    answer = F.to_json(F.array(F.struct(F.lit("lex").alias("type"), F.concat(F.lit(" "), "text").alias("query")), F.struct(F.lit("vec").alias("type"), F.concat(F.lit("known "), "text").alias("query"))))
    cache = items.where("query_id % 2 = 0").select(key.alias("hash"), answer.alias("result")).distinct()
    out = hybrid.expand(items, cache, pv.MockProvider())
    return out.select("query_id", "cached", F.posexplode("variants").alias("n", "v")).select("query_id", "cached", "n", "v.type", "v.query")


def queries() -> dict:
    doc = lambda f: lambda s, d: f(_docs(s, d))
    made = lambda f: lambda s, d: f(_made(s, d), "doc_id", F.col("body"))
    return {
        "content_hash_docid": doc(lambda x: x.select("doc_id", "hash", T.docid(F.col("hash")).alias("docid"), T.is_docid(F.concat(F.lit(' "#'), T.docid(F.col("hash")), F.lit('" '))).alias("quoted"), T.is_docid(F.col("path")).alias("plain"))),
        "extract_title": titles, "handelize_ascii": handelized,
        "intent_terms": lambda s, d: read_table(s, d, "benchmark").select("item_id", F.array_join(T.intent_terms(F.concat(F.lit("Find the (Notes) about: "), "text")), " ").alias("terms")),
        "snippet_best_line": snippets, "snippet_with_intent": snippets_with_intent, "expand_cached": expanded_queries, "display_formats": shown_sizes,
        "add_line_numbers": doc(lambda x: x.select("doc_id", T.add_line_numbers(F.col("body"), F.lit(5)).alias("numbered"))),
        "slice_lines": doc(lambda x: x.select("doc_id", T.slice_lines(F.col("body"), 3, 2).alias("part"))),
        "truncate_lines": doc(lambda x: x.select("doc_id", T.truncate_lines(F.col("body"), 4).alias("part"))),
        "line_at_offset": doc(lambda x: x.select("doc_id", T.line_at_char(F.col("body"), F.lit(200)).cast("int").alias("line"))),
        "virtual_path_parse": virtual_paths, "virtual_path_resolve": resolve_roots,
        "detect_language": lambda s, d: read_table(s, d, "part").select("p_partkey", T.language_of(F.concat("p_name", F.element_at(F.array(*[F.lit(e) for e in (".py", ".TS", ".md", ".rs", ".cjs", "")]), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("language")),
        "byte_vs_char_len": doc(lambda x: x.select("doc_id", F.octet_length("body").alias("bytes"), F.length("body").alias("chars"))),
        "days_since": times,
        "break_points": made(chunking.break_point_rows), "code_fences": made(chunking.fence_rows),
        "merge_break_points": lambda s, d: chunking.break_point_rows(_made(s, d), "doc_id", F.col("body")).unionByName(chunking.fence_rows(_made(s, d), "doc_id", F.col("body")).select("doc_id", F.col("start").alias("pos"), F.lit(95).alias("score"))).groupBy("doc_id", "pos").agg(F.max("score").alias("score")),
        "chunk_documents": lambda s, d: chunking.chunk_documents(_docs(s, d)), "chunk_by_tokens": lambda s, d: chunking.chunk_documents(_docs(s, d), by_tokens=True),
        "chunk_single_small_docs": lambda s, d: chunking.chunk_documents(_docs(s, d).where(F.octet_length("body") <= chunking.CHUNK_BYTES)),
        "best_chunk_keyword": best_chunks, "mock_embedding": mock_embeddings, "format_embedding_text": formatted, "expand_parse_output": expansions, "expand_fallback": fallback,
        "rerank_cache_key": cache_keys, "rerank_mock_cached": rerank_cached, "resolve_paths": resolved_paths, "embedding_batches": embedding_batches, "hybrid_query_mock": hybrid_mock, "structured_search_mock": structured_mock,
        "bm25_porter": lambda s, d: ft.search(s, _docs(s, d), [(1, "edition"), (2, "thing -was")], stem=True),
        "metrics_precision_recall_mrr_f1": scores, "bench_summary": lambda s, d: metrics.summary(scores(s, d), "backend"), "hit_at_k": lambda s, d: metrics.hit_rates(scores(s, d), "query_id"),
        "hits_csv_line": _sink("csv"), "hits_files_line": _sink("files"), "hits_md": _sink("md"), "hits_xml": _sink("xml"),
    }


def oracle_sql() -> dict[str, str]:
    terms = "the des queda und".split()
    hit = lambda col, ts, w="": " + ".join(f"contains(lower({col}), '{t}')::INT" for t in ts)
    snip = lambda src, key, q: f"""ls AS (SELECT {key}, string_split(text, chr(10)) AS l FROM {src}), li AS (SELECT {key}, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM ls),
bs AS (SELECT {key}, n, i AS hit FROM li QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {q} DESC, i) = 1),
sn AS (SELECT {key}, CAST(hit + 1 AS INT) AS line, array_to_string(l[greatest(hit - 1, 0) + 1:least(hit + 3, n)], chr(10)) AS snippet, CAST(greatest(hit - 1, 0) AS INT) AS before, CAST(n - least(hit + 3, n) AS INT) AS after, CAST(least(hit + 3, n) - greatest(hit - 1, 0) AS INT) AS count FROM bs JOIN ls USING ({key}))"""  # noqa: E731
    score = f"CASE WHEN regexp_matches(line, '^#{{1,6}}[^#]') THEN 110 - 10 * length(regexp_extract(line, '^#+')) WHEN regexp_matches(line, '^#{{1,6}}$') AND i < n - 1 THEN 110 - 10 * length(line) WHEN starts_with(line, '{TICKS}') THEN 80 WHEN regexp_matches(line, '^(---|\\*\\*\\*|___)[ \\t]*$') AND i < n - 1 THEN 60 WHEN line = '' AND i < n - 1 THEN 20 WHEN regexp_matches(line, '^([-*] |[0-9]+\\. )') THEN 5 ELSE 1 END"
    bp = f"{_MADE}, bp AS (SELECT doc_id, pos, CAST({score} AS INT) AS score FROM lp WHERE i > 0), fm AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, lead(pos) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM lp WHERE i > 0 AND starts_with(line, '{TICKS}')), fe AS (SELECT doc_id, CAST(k // 2 AS INT) AS fence, pos AS start, CAST(coalesce(nx + 4, size) AS BIGINT) AS \"end\" FROM fm WHERE k % 2 = 0)"
    hs = f"""WITH s AS ({search_sql([(1, 'the'), (2, 'de la')], limit=25)}), t AS (SELECT s.query_id, s.rank, s.docid, s.score, s.file, s.title, CASE WHEN s.collection = 'src1' THEN 'first, "one"' END AS context, d.text, s.query_id * 1000 + s.rank AS k FROM s JOIN documents d USING (doc_id)),
{snip('t', 'k', "CASE WHEN k < 2000 THEN contains(lower(line), 'the')::INT ELSE contains(lower(line), 'de')::INT + contains(lower(line), 'la')::INT END")},
h AS (SELECT t.query_id, t.rank, docid, score, file, title, context, sn.line, sn.snippet FROM t JOIN sn USING (k))"""
    csv = lambda x: f"CASE WHEN contains({x}, ',') OR contains({x}, '\"') OR contains({x}, chr(10)) THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
    esc = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    stop = ", ".join(f"'{w}'" for w in T.INTENT_STOP_WORDS)
    langs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    bt, it = ["the", "ration", "queda", "und"], ["erlich", "tion"]
    byte = lambda i: f"(instr('0123456789abcdef', sha256(text)[{2 * i + 1}]) - 1) * 16 + instr('0123456789abcdef', sha256(text)[{2 * i + 2}]) - 1"
    w = lambda n: f"array_to_string(string_split(text, ' ')[1:{n}], ' ')"
    fm = "CASE WHEN item_id % 2 = 0 THEN 'Qwen3-Embedding' ELSE 'other' END"
    return {
        "content_hash_docid": f"{D} SELECT doc_id, hash, left(hash, 6) AS docid, true AS quoted, false AS plain FROM docs",
        "extract_title": f"{D} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(nullif(trim(array_to_string(string_split(title, ' ')[1:3], ' ')), ''), CAST(doc_id AS VARCHAR)) WHEN 1 THEN coalesce(nullif(trim(array_to_string(string_split(title, ' ')[1:2], ' ')), ''), 'Notes') ELSE CAST(doc_id AS VARCHAR) END AS title FROM docs",
        "handelize_ascii": r"""WITH m AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '/My File (v' || page_id % 5 || ')/part two!' AS p FROM pages),
s AS (SELECT page_id, [regexp_replace(regexp_replace(x, '[^\p{L}\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g') FOR x IN string_split(p, '/')] AS x FROM m)
SELECT page_id, array_to_string(list_filter(x, lambda y: y <> ''), '/') || '.MD' AS path, CAST(NULL AS VARCHAR) AS nothing FROM s""",
        "intent_terms": rf"""WITH w AS (SELECT item_id, [regexp_replace(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') FOR x IN regexp_split_to_array(lower('Find the (Notes) about: ' || text), '\s+')] AS x FROM benchmark)
SELECT item_id, array_to_string(list_filter(x, lambda y: strlen(y) > 1 AND y NOT IN ({stop})), ' ') AS terms FROM w""",
        "snippet_best_line": f"WITH {snip('documents', 'doc_id', hit('line', terms))} SELECT *, '@@ -' || (before + 1) || ',' || count || ' @@ (' || before || ' before, ' || after || ' after)' AS header FROM sn",
        "snippet_with_intent": f"""WITH {snip('documents', 'doc_id', '(' + hit('line', terms) + ") + 0.3::DOUBLE * (" + hit('line', ['tion', 'erlich']) + ')')}
SELECT doc_id, line, '@@ -' || (before + 1) || ',' || count || ' @@ (' || before || ' before, ' || after || ' after)' || chr(10) || snippet AS snippet, before, after, count FROM sn""",
        "expand_cached": f"""WITH b AS (SELECT CAST(item_id AS INT) AS query_id, lower({w(3)}) AS t, CASE WHEN item_id % 3 = 0 THEN chr(10) || 'Intent: about words' ELSE '' END AS i FROM benchmark),
k AS (SELECT DISTINCT t, i FROM b WHERE query_id % 2 = 0), c AS (SELECT b.*, k.t IS NOT NULL AS cached FROM b LEFT JOIN k USING (t, i))
SELECT query_id, cached, 0 AS n, CASE WHEN cached THEN 'vec' ELSE 'hyde' END AS type, CASE WHEN cached THEN 'known ' || t ELSE 'doc about ' || t || i END AS query FROM c
UNION ALL SELECT query_id, cached, 1, 'vec', 'semantic ' || t || i FROM c WHERE NOT cached""",
        "display_formats": f"""WITH o AS (SELECT o_orderkey, CAST(o_totalprice * 100 AS BIGINT) AS p, o_orderkey % 9000 AS s, o_orderdate AS made, {NOW} - epoch(o_orderdate)::BIGINT AS gone FROM orders),
f AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.1f}} KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{{:.1f}} MB', n / 1048576.0::DOUBLE) ELSE format('{{:.1f}} GB', n / 1073741824.0::DOUBLE) END AS size, format('{{:,}}', n) AS count,
CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS duration,
CASE WHEN gone < 60 THEN gone || 's ago' WHEN gone < 3600 THEN (gone // 60) || 'm ago' WHEN gone < 86400 THEN (gone // 3600) || 'h ago' ELSE (gone // 86400) || 'd ago' END AS ago,
strftime(made, '%b ') || lpad(CAST(day(made) AS VARCHAR), 2, ' ') || CASE WHEN gone > 15552000 THEN '  ' || year(made) ELSE strftime(made, ' %H:%M') END AS listed FROM o JOIN f USING (o_orderkey)""",
        "add_line_numbers": f"{D} SELECT doc_id, array_to_string([CAST(i + 4 AS VARCHAR) || ': ' || x FOR x, i IN string_split(body, chr(10))], chr(10)) AS numbered FROM docs",
        "slice_lines": f"{D} SELECT doc_id, array_to_string(string_split(body, chr(10))[3:4], chr(10)) AS part FROM docs",
        "truncate_lines": f"{D} SELECT doc_id, CASE WHEN len(string_split(body, chr(10))) > 4 THEN array_to_string(string_split(body, chr(10))[1:4], chr(10)) || chr(10) || chr(10) || '[... truncated ' || (len(string_split(body, chr(10))) - 4) || ' more lines]' ELSE body END AS part FROM docs",
        "line_at_offset": f"{D} SELECT doc_id, CAST(length(left(body, 200)) - length(replace(left(body, 200), chr(10), '')) + 1 AS INT) AS line FROM docs",
        "virtual_path_parse": f"{D} SELECT doc_id, collection, path, CASE WHEN doc_id % 2 = 0 THEN 'my index' END AS index, true AS is_virtual FROM docs",
        "virtual_path_resolve": f"{D} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'data' WHEN starts_with(path, 'en/') THEN 'english' ELSE 'texts' END AS collection, CASE WHEN doc_id % 4 <> 0 AND starts_with(path, 'en/') THEN path[4:] ELSE path END AS rest FROM docs",
        "detect_language": f"SELECT p_partkey, CASE lower(regexp_extract(p_name || ['.py', '.TS', '.md', '.rs', '.cjs', ''][p_partkey % 6 + 1], '\\.([^./]+)$', 1)) {langs} END AS language FROM part",
        "byte_vs_char_len": f"{D} SELECT doc_id, CAST(strlen(body) AS INT) AS bytes, CAST(length(body) AS INT) AS chars FROM docs",
        "days_since": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS rfc3339, CAST(DATE '2030-01-01' - CAST(o_orderdate AS DATE) AS INT) AS days FROM orders",
        "break_points": f"WITH {bp} SELECT * FROM bp", "code_fences": f"WITH {bp} SELECT * FROM fe",
        "merge_break_points": f"WITH {bp} SELECT doc_id, pos, max(score) AS score FROM (SELECT * FROM bp UNION ALL SELECT doc_id, start, 95 FROM fe) GROUP BY ALL",
        "chunk_single_small_docs": f"{D} SELECT doc_id, 0 AS seq, 0::BIGINT AS pos, 0::BIGINT AS char_pos, body AS text FROM docs WHERE strlen(body) <= 3600",
        "best_chunk_keyword": f"""WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
sc AS (SELECT doc_id, seq, ({hit('c', bt)}) + 0.5::DOUBLE * ({hit('c', it)}) AS score FROM li) SELECT doc_id, score, CAST(seq AS INT) AS seq FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) = 1""",
        "mock_embedding": "SELECT item_id, " + ", ".join(f"round(({byte(i)}) / 128.0::DOUBLE - 1, 6) AS v{i}" for i in range(4)) + " FROM benchmark",
        "format_embedding_text": f"""WITH b AS (SELECT item_id, text, {fm} AS m, CASE WHEN item_id % 3 > 0 THEN {w(2)} END AS t FROM benchmark)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Instruct: Retrieve relevant documents for the given query' || chr(10) || 'Query: ' || text ELSE 'task: search result | query: ' || text END AS query,
CASE WHEN item_id % 2 = 0 THEN CASE WHEN t IS NULL OR t = '' THEN text ELSE t || chr(10) || text END ELSE 'title: ' || coalesce(nullif(t, ''), 'none') || ' | text: ' || text END AS document, left(sha256(m || chr(10) || '900' || chr(10) || text), 6) AS fingerprint FROM b""",
        "expand_parse_output": f"""WITH b AS (SELECT item_id, {w(5)} AS t FROM benchmark), o AS (SELECT item_id, string_split('lex: ' || t || chr(10) || 'noise' || chr(10) || 'vec: about nothing' || chr(10) || 'hyde:  ' || t || ': more ' || chr(10) || 'bad: x', chr(10)) AS l FROM b),
e AS (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM o), k AS (SELECT item_id, i, trim(split_part(x, ':', 1)) AS type, trim(substr(x, instr(x, ':') + 1)) AS query FROM e WHERE contains(x, ':'))
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INT) AS n, type, query FROM k WHERE type IN ('lex', 'vec', 'hyde') AND query <> ''""",
        "expand_fallback": f"WITH b AS (SELECT item_id, lower({w(1)}) || ' zz' AS q FROM benchmark) SELECT item_id, n::INT AS n, type, CASE WHEN type = 'hyde' THEN 'Information about ' || q ELSE q END AS query FROM b, (VALUES (0, 'hyde'), (1, 'lex'), (2, 'vec')) v(n, type)",
        "rerank_cache_key": "SELECT event_id, sha256('rerank{\"query\":\"' || event_type || '\",\"model\":\"mock-reranker\",\"chunk\":\"chunk ' || user_id || '\"}') AS key FROM events",
        "rerank_mock_cached": f"""WITH q AS (SELECT {w(3)} AS query FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT doc_id, text AS chunk FROM documents), c AS (SELECT DISTINCT chunk FROM d WHERE doc_id % 2 = 0),
x AS (SELECT doc_id, query, chunk, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: length(t) > 1) AS ws FROM d, q)
SELECT doc_id, query, CASE WHEN chunk IN (SELECT chunk FROM c) THEN 0.5::DOUBLE ELSE round(CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda t: contains(lower(chunk), t)))::DOUBLE / len(ws) END, 6) END AS rerank, chunk IN (SELECT chunk FROM c) AS cached FROM x""",
        "resolve_paths": f"WITH {derived.SQL}, {_RESOLVED} SELECT doc_id, resolved, false AS absolute, CASE WHEN starts_with(resolved, '/data/texts/') THEN substr(resolved, 13) END AS under_texts FROM f",
        "embedding_batches": f"WITH RECURSIVE {derived.SQL}, {_BATCHES} SELECT doc_id, o.collection, path, bytes, batch FROM o JOIN f ON o.collection = f.collection AND o.i = f.i",
        "hybrid_query_mock": _hybrid_sql(), "structured_search_mock": _structured_sql(),
        "metrics_precision_recall_mrr_f1": f"{_SCORES} SELECT * FROM sc",
        "bench_summary": f"{_SCORES} SELECT backend, count(*) AS queries, round(sum(CAST(precision_at_k AS DECIMAL(18,6)))::DOUBLE / count(*), 6) AS avg_precision_at_k, round(sum(CAST(recall AS DECIMAL(18,6)))::DOUBLE / count(*), 6) AS avg_recall, round(sum(CAST(mrr AS DECIMAL(18,6)))::DOUBLE / count(*), 6) AS avg_mrr, round(sum(CAST(f1 AS DECIMAL(18,6)))::DOUBLE / count(*), 6) AS avg_f1 FROM sc GROUP BY 1",
        "hit_at_k": f"{_SCORES} SELECT query_id, round(avg((recall_at_1 > 0)::INT), 6) AS hit_at_1, round(avg((recall_at_3 > 0)::INT), 6) AS hit_at_3, round(avg((recall_at_5 > 0)::INT), 6) AS hit_at_5 FROM sc GROUP BY 1",
        "hits_csv_line": f"{hs} SELECT query_id, rank, concat_ws(',', docid, format('{{:.4f}}', round(score, 4)), {csv('file')}, {csv('title')}, {csv('coalesce(context, chr(0))').replace('chr(0)', chr(39) * 2)}, line, {csv('snippet')}) AS value FROM h",
        "hits_files_line": f"{hs} SELECT query_id, rank, '#' || docid || ',' || format('{{:.2f}}', round(score, 2)) || ',' || file || coalesce(',\"' || context || '\"', '') AS value FROM h",
        "hits_md": f"{hs} SELECT query_id, rank, '---' || chr(10) || '# ' || title || chr(10) || chr(10) || '**docid:** `#' || docid || '`' || chr(10) || coalesce('**context:** ' || context || chr(10), '') || chr(10) || snippet || chr(10) AS value FROM h",
        "hits_xml": f"{hs} SELECT query_id, rank, '<file docid=\"#' || docid || '\" name=\"' || {esc('file')} || '\" title=\"' || {esc('title')} || '\">' || chr(10) || {esc('snippet')} || chr(10) || '</file>' AS value FROM h",
    }
