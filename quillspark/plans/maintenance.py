"""Registered queries of the catalogue, contexts and lookups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, context, lookup
from ..sources import derived

MODEL, FINGERPRINT = derived.MODEL, "fp0"


def _docs(s, d):
    return derived.documents(s, d)


def _vectors(s, d):
    return derived.chunk_vectors(s, d).join(_docs(s, d).select("doc_id", "hash"), "doc_id")


_V = f"WITH {derived.SQL}, hv AS (SELECT v.*, d.hash FROM vecs v JOIN docs d USING (doc_id))"


def _snapshot(s, d):
    """An older state: every eleventh document unknown, some with another text or title, one path that is gone."""
    docs = _docs(s, d).where("doc_id % 11 <> 0")
    docs = docs.withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.sha2("hash", 256)).otherwise(F.col("hash"))).withColumn("title", F.when(F.col("doc_id") % 7 == 0, F.concat("title", F.lit("?"))).otherwise(F.col("title")))
    gone = docs.where("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("old/"), "path"))
    return docs.unionByName(gone).withColumn("created_at", F.lit("2023-01-01T00:00:00.000Z"))


_SNAP = f"""WITH {derived.SQL},
s0 AS (SELECT collection, path, CASE WHEN doc_id % 7 = 0 THEN title || '?' ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN sha256(hash) ELSE hash END AS hash, doc_id, active FROM docs WHERE doc_id % 11 <> 0),
snap AS (SELECT * FROM s0 UNION ALL SELECT collection, 'old/' || path, title, hash, doc_id, active FROM s0 WHERE doc_id % 13 = 0)"""


def upserted(s, d):
    new = _docs(s, d).where("doc_id % 3 = 0").withColumn("created_at", F.lit("2024-06-01T00:00:00.000Z"))
    return catalog.upsert(_snapshot(s, d), new.select(*_snapshot(s, d).columns)).select("collection", "path", "hash", "active", "created_at")


def legacy(s, d):
    old = _docs(s, d).withColumn("path", F.when(F.col("doc_id") % 4 == 0, F.upper("path")).otherwise(F.col("path")))
    return catalog.legacy_paths(old, _docs(s, d).select("collection", "path"))


def _contexts(s):
    rows = [("src1", "/", "All of source one"), ("src1", "/en", "English texts"), ("src1", "/en/1", "Those that begin with 1"), ("src2", "/fr/", "Textes"), ("src3", "/", "Source three")]
    return s.createDataFrame(rows, "collection string, prefix string, context string")


_CTX = "ctx(collection, prefix, context) AS (VALUES ('src1', '/', 'All of source one'), ('src1', '/en', 'English texts'), ('src1', '/en/1', 'Those that begin with 1'), ('src2', '/fr/', 'Textes'), ('src3', '/', 'Source three'))"
GLOBAL = "For everyone"


def _collections(s, d):
    return _docs(s, d).select(F.col("collection").alias("name")).distinct()


def _names(s, d):
    docs = _docs(s, d).where("doc_id % 20 = 0")
    forms = F.array(F.left("hash", F.lit(8)), F.concat(F.lit("#"), F.left("hash", F.lit(6))), F.concat(F.lit(f"{derived.SCHEME}://"), "collection", F.lit("/"), "path"), F.concat("path", F.lit(":12")), F.concat(F.lit("zz"), "path"))
    return docs.select(F.explode(forms).alias("query")).distinct()


_NAMES = """names AS (SELECT DISTINCT unnest([left(hash, 8), '#' || left(hash, 6), 'quill://' || collection || '/' || path, path || ':12', 'zz' || path]) AS query FROM docs WHERE doc_id % 20 = 0),
nq AS (SELECT query, regexp_replace(query, ':[0-9]+$', '') AS q FROM names),
vp AS (SELECT collection, path, hash, 'quill://' || collection || '/' || path AS v, length(body) AS size FROM docs WHERE active),
st AS (SELECT query, collection, path, v, size, CASE WHEN regexp_matches(ltrim(q, '#'), '^[0-9a-fA-F]{6,}$') THEN CASE WHEN starts_with(hash, lower(ltrim(q, '#'))) THEN 1 END WHEN v = q THEN 2 WHEN ends_with(lower(v), lower(q)) THEN 3 END AS stage FROM vp, nq),
best AS (SELECT * FROM st WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY stage, v) = 1)"""
_HOW = "coalesce(CASE stage WHEN 1 THEN 'docid' WHEN 2 THEN 'exact' WHEN 3 THEN 'suffix' END, 'none') AS how"


def docid_lookup(s, d):
    return lookup.by_docid(_docs(s, d), _names(s, d))


def similar_files(s, d):
    wanted = _docs(s, d).where("doc_id % 20 = 0").select(F.regexp_replace("path", "\\.md$", ".nd").alias("query"))
    return lookup.similar(_docs(s, d), wanted, 2, 5)


def suggested(s, d):
    """Names of every twentieth document; what no stage finds comes with the paths most like it."""
    return lookup.find_or_suggest(_docs(s, d), _names(s, d)).withColumn("suggestions", F.array_join("suggestions", "|"))


def _status(s, d):
    return catalog.status(_docs(s, d), _vectors(s, d), MODEL, FINGERPRINT)


_PENDING = f"""{_V}, done AS (SELECT hash FROM hv WHERE model = '{MODEL}' AND fingerprint = '{FINGERPRINT}' GROUP BY hash HAVING count(DISTINCT seq) >= max(total_chunks)),
pend AS (SELECT hash, min(path) AS path, CAST(max(strlen(body)) AS BIGINT) AS bytes FROM docs WHERE active AND hash NOT IN (SELECT hash FROM done) GROUP BY hash)"""


def queries() -> dict:
    return {
        "reindex_classify": lambda s, d: catalog.classify(_snapshot(s, d), _docs(s, d).where("doc_id % 17 <> 0")),
        "reindex_counts": lambda s, d: catalog.classify(_snapshot(s, d), _docs(s, d).where("doc_id % 17 <> 0")).groupBy("action").agg(F.count("*").alias("n")),
        "content_dedupe": lambda s, d: catalog.new_content(derived.content(s, d).where("hash < '8'"), _docs(s, d).select("hash", F.col("body").alias("doc"))).select("hash", F.octet_length("doc").alias("bytes")),
        "document_upsert": upserted, "legacy_path_migrate": legacy,
        "orphan_content": lambda s, d: catalog.orphaned_content(derived.content(s, d), _docs(s, d), only_active=True).select("hash"),
        "orphan_vectors": lambda s, d: catalog.orphaned_vectors(_vectors(s, d), _docs(s, d)).select("vec_id", "hash", "seq"),
        "exclusive_hashes": lambda s, d: catalog.exclusive_hashes(_docs(s, d), "src3"),
        "incomplete_embeddings": lambda s, d: catalog.incomplete(_vectors(s, d)),
        "pending_docs": lambda s, d: catalog.pending(_docs(s, d), _vectors(s, d), MODEL, FINGERPRINT),
        "needs_embedding_count": lambda s, d: catalog.pending(_docs(s, d), _vectors(s, d), MODEL, FINGERPRINT).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")),
        "fingerprint_groups": lambda s, d: catalog.fingerprint_groups(_vectors(s, d)),
        "adopt_legacy": lambda s, d: catalog.fingerprint_groups(catalog.adopt_legacy(_vectors(s, d).withColumn("fingerprint", F.when(F.col("fingerprint") != "fp1", F.col("fingerprint"))), "new")),
        "collection_listing": lambda s, d: catalog.collection_listing(_collections(s, d).union(s.range(1).select(F.lit("empty"))), _docs(s, d)),
        "index_status": _status,
        "index_health": lambda s, d: catalog.health(_docs(s, d), _vectors(s, d), MODEL, FINGERPRINT, F.to_date(F.lit("2026-01-01"))),
        "remove_collection": lambda s, d: catalog.orphaned_content(derived.content(s, d), catalog.remove_collection(_docs(s, d), "src3"), only_active=True).select("hash"),
        "rename_collection": lambda s, d: catalog.rename_collection(_docs(s, d), "src3", "renamed").groupBy("collection").agg(F.count("*").alias("n")),
        "deactivate_missing": lambda s, d: catalog.deactivate(_docs(s, d), _docs(s, d).where("doc_id % 6 = 0").select("collection", "path")).select("doc_id", "active"),
        "batch_by_count": lambda s, d: catalog.batches_by_count(_docs(s, d).where("active"), ["collection"], ["path"], 8).groupBy("collection", "batch").agg(F.count("*").alias("n"), F.min("path").alias("first")),
        "context_all_prefixes": lambda s, d: context.all_prefixes(_docs(s, d), _contexts(s), GLOBAL),
        "context_longest_prefix": lambda s, d: context.longest_prefix(_docs(s, d), _contexts(s), GLOBAL),
        "collections_without_context": lambda s, d: context.collections_without(_collections(s, d), _contexts(s)),
        "top_paths_without_context": lambda s, d: context.top_paths_without(_docs(s, d), _contexts(s)),
        "list_contexts": lambda s, d: context.listing(_contexts(s).join(_collections(s, d), F.col("collection") == F.col("name"), "left_semi"), GLOBAL),
        "find_document_staged": lambda s, d: lookup.find(_docs(s, d), _names(s, d)),
        "find_by_docid": docid_lookup,
        "multi_get_glob": lambda s, d: lookup.multi_get(_docs(s, d), "src[1-3]/{en,fr}/*6?.md", 3000),
        "multi_get_comma": lambda s, d: lookup.multi_get_list(_docs(s, d), _names(s, d), 3000),
        "multi_get_size_skip": lambda s, d: lookup.with_size_limit(_docs(s, d), 3000),
        "similar_files": similar_files,
        "find_or_suggest": suggested,
        "ls_prefix": lambda s, d: lookup.list_files(_docs(s, d), "src3", "en/"),
    }


def oracle_sql() -> dict[str, str]:
    d = f"WITH {derived.SQL}"
    cls = f"""{_SNAP}, seen AS (SELECT * FROM docs WHERE doc_id % 17 <> 0),
j AS (SELECT coalesce(s.collection, n.collection) AS collection, coalesce(s.path, n.path) AS path, s.hash AS oh, s.title AS ot, s.active AS act, n.hash AS nh, n.title AS nt FROM snap s FULL JOIN seen n ON s.collection = n.collection AND s.path = n.path),
c AS (SELECT collection, path, CASE WHEN nh IS NULL THEN CASE WHEN act THEN 'removed' END WHEN oh IS NULL THEN 'indexed' WHEN act AND oh = nh AND ot IS NOT DISTINCT FROM nt THEN 'unchanged' ELSE 'updated' END AS action FROM j)"""
    size = "CASE WHEN length(body) > 3000 THEN 'File too large (' || CAST(round(length(body) / 1024.0::DOUBLE) AS INT) || 'KB > 3KB)' END"
    fit = f"{d}, {_CTX}, fit AS (SELECT docs.collection, path, prefix, context FROM docs JOIN ctx ON docs.collection = ctx.collection AND starts_with('/' || path, prefix))"
    return {
        "reindex_classify": f"{cls} SELECT * FROM c WHERE action IS NOT NULL",
        "reindex_counts": f"{cls} SELECT action, count(*) AS n FROM c WHERE action IS NOT NULL GROUP BY 1",
        "content_dedupe": f"{d} SELECT hash, CAST(strlen(doc) AS INT) AS bytes FROM content WHERE hash >= '8'",
        "document_upsert": f"""{_SNAP}, nw AS (SELECT * FROM docs WHERE doc_id % 3 = 0)
SELECT collection, path, hash, active, '2023-01-01T00:00:00.000Z' AS created_at FROM snap WHERE (collection, path) NOT IN (SELECT (collection, path) FROM nw)
UNION ALL SELECT n.collection, n.path, n.hash, true, CASE WHEN s.path IS NULL THEN '2024-06-01T00:00:00.000Z' ELSE '2023-01-01T00:00:00.000Z' END FROM nw n LEFT JOIN snap s ON n.collection = s.collection AND n.path = s.path""",
        "legacy_path_migrate": f"{d} SELECT collection, path, upper(path) AS legacy_path FROM docs WHERE active AND doc_id % 4 = 0",
        "orphan_content": f"{d} SELECT hash FROM content WHERE hash NOT IN (SELECT hash FROM docs WHERE active)",
        "orphan_vectors": f"{_V} SELECT vec_id, hash, seq FROM hv WHERE hash NOT IN (SELECT hash FROM docs WHERE active)",
        "exclusive_hashes": f"{d} SELECT hash FROM docs WHERE active GROUP BY hash HAVING count(DISTINCT collection) = 1 AND bool_or(collection = 'src3')",
        "incomplete_embeddings": f"{_V} SELECT hash, model, CAST(count(DISTINCT seq) AS INT) AS chunks, max(total_chunks) AS expected FROM hv GROUP BY ALL HAVING count(DISTINCT seq) <> max(total_chunks)",
        "pending_docs": f"{_PENDING} SELECT hash, path, bytes FROM pend",
        "needs_embedding_count": f"{_PENDING} SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM pend",
        "fingerprint_groups": f"{_V} SELECT model, fingerprint, count(DISTINCT hash) AS documents, count(*) AS chunks FROM hv GROUP BY ALL",
        "adopt_legacy": f"{_V} SELECT model, CASE WHEN fingerprint = 'fp1' THEN 'new' ELSE fingerprint END AS fingerprint, count(DISTINCT hash) AS documents, count(*) AS chunks FROM hv GROUP BY ALL",
        "collection_listing": f"{d} SELECT collection AS name, count(*) AS documents, count(*) FILTER (active) AS active, max(modified_at) AS last_modified FROM docs GROUP BY 1 UNION ALL SELECT 'empty', 0, 0, NULL",
        "index_status": f"{_PENDING} SELECT collection, count(*) AS active, max(modified_at) AS last_modified, count(DISTINCT CASE WHEN hash IN (SELECT hash FROM pend) THEN hash END) AS needs_embedding FROM docs WHERE active GROUP BY GROUPING SETS ((collection), ())",
        "index_health": f"{_PENDING} SELECT count(*) AS total, CAST(DATE '2026-01-01' - CAST(left(max(modified_at), 10) AS DATE) AS INT) AS days_stale, (SELECT count(*) FROM pend) AS needs_embedding FROM docs WHERE active",
        "remove_collection": f"{d} SELECT hash FROM content WHERE hash NOT IN (SELECT hash FROM docs WHERE active AND collection <> 'src3')",
        "rename_collection": f"{d} SELECT CASE WHEN collection = 'src3' THEN 'renamed' ELSE collection END AS collection, count(*) AS n FROM docs GROUP BY 1",
        "deactivate_missing": f"{d} SELECT doc_id, active AND doc_id % 6 <> 0 AS active FROM docs",
        "batch_by_count": f"{d}, b AS (SELECT collection, path, CAST((row_number() OVER (PARTITION BY collection ORDER BY path) - 1) // 8 AS INT) AS batch FROM docs WHERE active) SELECT collection, batch, count(*) AS n, min(path) AS first FROM b GROUP BY ALL",
        "context_all_prefixes": f"{fit}, g AS (SELECT collection, path, string_agg(context, chr(10) || chr(10) ORDER BY length(prefix)) AS c FROM fit GROUP BY ALL) SELECT docs.collection, docs.path, '{GLOBAL}' || coalesce(chr(10) || chr(10) || c, '') AS context FROM docs LEFT JOIN g USING (collection, path)",
        "context_longest_prefix": f"{fit}, g AS (SELECT collection, path, arg_max(context, length(prefix)) AS c FROM fit GROUP BY ALL) SELECT docs.collection, docs.path, coalesce(c, '{GLOBAL}') AS context FROM docs LEFT JOIN g USING (collection, path)",
        "collections_without_context": f"{d}, {_CTX} SELECT DISTINCT collection AS name FROM docs WHERE collection NOT IN (SELECT collection FROM ctx)",
        "top_paths_without_context": f"{d}, {_CTX} SELECT DISTINCT collection, split_part(path, '/', 1) AS top FROM docs WHERE active AND (collection, split_part(path, '/', 1)) NOT IN (SELECT (collection, split_part(ltrim(prefix, '/'), '/', 1)) FROM ctx)",
        "list_contexts": f"{d}, {_CTX} SELECT * FROM ctx WHERE collection IN (SELECT collection FROM docs) UNION ALL SELECT '*', '/', '{GLOBAL}'",
        "find_document_staged": f"{d}, {_NAMES} SELECT n.query, {_HOW}, collection, path FROM names n LEFT JOIN best b USING (query)",
        "find_by_docid": f"""{d}, {_NAMES}, h AS (SELECT query, doc_id, path, hash FROM docs, names WHERE active AND regexp_matches(ltrim(query, '#'), '^[0-9a-fA-F]{{6,}}$') AND starts_with(hash, lower(ltrim(query, '#'))))
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY path, doc_id) = 1""",
        "multi_get_glob": f"{d} SELECT doc_id, collection, path, CAST(length(body) AS INT) AS size, {size} AS reason FROM docs WHERE active AND regexp_matches(collection || '/' || path, '^src[1-3]/(en|fr)/.*6.\\.md$')",
        "multi_get_comma": f"{d}, {_NAMES} SELECT n.query, {_HOW}, path, CASE WHEN size > 3000 THEN 'File too large (' || CAST(round(size / 1024.0::DOUBLE) AS INT) || 'KB > 3KB)' END AS reason FROM names n LEFT JOIN best b USING (query)",
        "multi_get_size_skip": f"{d} SELECT doc_id, collection, path, CAST(length(body) AS INT) AS size, {size} AS reason FROM docs",
        "similar_files": f"""{d}, w AS (SELECT regexp_replace(path, '\\.md$', '.nd') AS query FROM docs WHERE doc_id % 20 = 0), p AS (SELECT DISTINCT path FROM docs WHERE active),
l AS (SELECT query, path, CAST(levenshtein(lower(path), lower(query)) AS INT) AS distance FROM p, w)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, path) AS INT) AS rank, path, distance FROM l WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, path) <= 5""",
        "find_or_suggest": f"""{d}, {_NAMES}, a AS (SELECT n.query, {_HOW}, collection, path FROM names n LEFT JOIN best b USING (query)), p AS (SELECT DISTINCT path FROM docs WHERE active),
l AS (SELECT query, p.path, levenshtein(lower(p.path), lower(query)) AS distance FROM a, p WHERE how = 'none' AND NOT regexp_matches(ltrim(query, '#'), '^[0-9a-fA-F]{{6,}}$')),
k AS (SELECT query, string_agg(path, '|' ORDER BY distance, path) AS suggestions FROM (SELECT * FROM l WHERE distance <= 5 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, path) <= 5) GROUP BY query)
SELECT a.*, coalesce(suggestions, '') AS suggestions FROM a LEFT JOIN k USING (query)""",
        "ls_prefix": f"{d} SELECT path, title, CAST(length(body) AS INT) AS size, modified_at FROM docs WHERE active AND collection = 'src3' AND starts_with(path, 'en/')",
    }
