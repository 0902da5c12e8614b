"""Full-text retrieval: token tables, BM25 with column weights, phrases, prefixes and negation.

Queries are rows, so that one plan answers them all: query items meet the
postings first, and only what matches meets anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import virtual_path
from ..functions.query_language import parse_lexical
from ..functions.stemming import porter, stemmed, stems
from ..functions.text import docid, normalize_cjk, tokens

#: Weights of the indexed columns, BM25's two constants, and what an item's weight is at least.
WEIGHTS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
OVERFETCH = 10
DEFAULT_LIMIT = 20


def token_table(documents: DataFrame, cjk: bool = True) -> DataFrame:
    """(doc_id, col, pos, term) of the active ``documents``: the postings, one row an occurrence."""
    docs = documents.where("active")
    prepared = normalize_cjk if cjk else (lambda x: x)
    columns = {"filepath": F.concat("collection", F.lit("/"), "path"), "title": F.col("title"), "body": F.col("body")}
    each = F.array(*[F.struct(F.lit(k).alias("col"), tokens(prepared(v)).alias("terms")) for k, v in columns.items()])
    rows = docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.col", F.posexplode("x.terms").alias("pos", "term"))
    return rows


def postings(tokens_: DataFrame) -> DataFrame:
    """(doc_id, col, term, tf, positions): the inverted index as it is stored."""
    return tokens_.groupBy("doc_id", "col", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def stemmed_postings(rows: DataFrame) -> DataFrame:
    """Postings (of stored ``rows``, which are read twice) with each term replaced by its stem; terms of one stem become one posting.

    Only distinct terms are stemmed, and postings are fewer than occurrences.
    """
    joined = rows.join(stems(rows), "term").groupBy("doc_id", "col", F.col("stem").alias("term"))
    return joined.agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def vocabulary(tokens_: DataFrame) -> DataFrame:
    """(term, df, occurrences)."""
    return tokens_.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("occurrences"))


def lengths(tokens_: DataFrame) -> DataFrame:
    """(doc_id, dl): the tokens of each document that has any, over all columns."""
    return tokens_.groupBy("doc_id").agg(F.count("*").alias("dl"))


def matches(term: Column, items: DataFrame) -> Column:
    """Whether a term is a token of ``items``, or begins with one that is a prefix."""
    return F.when(items["prefix"], term.startswith(items["token"])).otherwise(term == items["token"])


#: Terms that a scan is asked for by name.  More are asked for by their range, and sorted out after it.
NAMED_TERMS = 200
Item = tuple[int, int, bool, bool, int, int, str]


def asked_terms(items: list[Item]) -> Column:
    """A condition on ``term`` that every term which ``items`` ask for meets, in a form that Parquet scans understand."""
    asked = sorted({(x[6], x[3]) for x in items})
    if not asked:
        return F.lit(False)
    term = F.col("term")
    if len(asked) > NAMED_TERMS:
        return (term >= asked[0][0]) & (term <= max(t for t, _ in asked) + "\U0010ffff")
    out = F.lit(False)
    for token, prefix in asked:
        out = out | (term.startswith(token) if prefix else term == token)
    return out


def item_rows(queries: list[tuple[int, str]], stem: bool = False) -> list[Item]:
    """(query_id, item, negated, prefix, k, m, token): a row for each token of each item of each query."""
    shape = porter if stem else (lambda t: t)
    rows = []
    for q, text in queries:
        for i, item in enumerate(parse_lexical(text)):
            for k, t in enumerate(item.tokens or ("\u0000",)):
                last = k == max(0, len(item.tokens) - 1)
                rows.append((q, i, item.negated, item.prefix and last, k, max(1, len(item.tokens)), shape(t)))
    return rows


def items_frame(spark: SparkSession, rows: list[Item]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, item int, negated boolean, prefix boolean, k int, m int, token string")


def query_items(spark: SparkSession, queries: list[tuple[int, str]], stem: bool = False) -> DataFrame:
    """The rows of :func:`item_rows` as a table."""
    return items_frame(spark, item_rows(queries, stem))


def occurrences(tokens_: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item, negated, doc_id, col, occ): how often each item occurs in each column of each document.

    Items are few, bounded by the queries, so they are broadcast and postings
    are matched where they lie; only what matches is shuffled.
    """
    found = tokens_.join(F.broadcast(items), matches(F.col("term"), items)).select("query_id", "item", "negated", "doc_id", "col", (F.col("pos") - F.col("k")).alias("base"), "k", "m")
    single = found.where("m = 1").groupBy("query_id", "item", "negated", "doc_id", "col").agg(F.count("*").alias("occ"))
    phrase = found.where("m > 1").groupBy("query_id", "item", "negated", "doc_id", "col", "base", "m").agg(F.countDistinct("k").alias("got")).where("got = m")
    phrase = phrase.groupBy("query_id", "item", "negated", "doc_id", "col").agg(F.count("*").alias("occ"))
    return single.unionByName(phrase)


def bm25(documents: DataFrame, items: DataFrame, tokens_: DataFrame | None = None, dl: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25) for documents with all positive items of a query and none of the negated ones; less is better.

    With ``dl``, the stored :func:`lengths`, ``tokens_`` need hold no other terms than the items'.
    """
    tokens_ = token_table(documents) if tokens_ is None else tokens_
    total = documents.where("active").agg(F.count("*").alias("n_docs"))
    dl = lengths(tokens_) if dl is None else dl
    size = dl.agg(F.sum("dl").alias("tokens"))
    occ = occurrences(tokens_, items)
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("col") == name, w).otherwise(weight)
    per = occ.groupBy("query_id", "item", "negated", "doc_id").agg(F.sum(weight * F.col("occ")).alias("f"))
    df = per.where("not negated").groupBy("query_id", "item").agg(F.count("*").alias("df"))
    need = items.where("not negated").groupBy("query_id").agg(F.countDistinct("item").alias("need"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.crossJoin(F.broadcast(total)).withColumn("idf", F.when(idf > 0, idf).otherwise(LEAST_IDF)).drop("df")
    scored = per.where("not negated").join(F.broadcast(df), ["query_id", "item"]).join(dl, "doc_id").crossJoin(F.broadcast(size))
    long = 1 - B + B * F.col("dl") / (F.col("tokens") / F.col("n_docs"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * long)
    out = scored.groupBy("query_id", "doc_id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("got"))
    out = out.join(F.broadcast(need), "query_id").where("got = need").select("query_id", "doc_id", "bm25")
    return out.join(per.where("negated").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def search(spark: SparkSession, documents: DataFrame, queries: list[tuple[int, str]], limit: int = DEFAULT_LIMIT, collection: str | None = None, min_score: float = 0.0, exact: bool = False, stem: bool = False, tokens_: DataFrame | None = None, dl: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """The best documents for each query: query_id, rank, doc_id, docid, collection, path, file, title, score.

    With a collection, ten times ``limit`` documents are fetched before those
    of others are dropped; ``exact`` filters first.  With ``stem``, terms of
    documents and queries are Porter stems.  Ties go by document id.  A stored
    text index comes in as ``tokens_`` and ``dl`` (with their ``items``).
    """
    if tokens_ is None and stem:
        tokens_ = stemmed(token_table(documents))
    ranked = bm25(documents, query_items(spark, queries, stem) if items is None else items, tokens_, dl)
    cut = limit * OVERFETCH if collection and not exact else limit
    facts = documents.where("active").select("doc_id", docid(F.col("hash")).alias("docid"), "collection", "path", "title")
    if collection and exact:
        ranked = ranked.join(facts.where(F.col("collection") == collection).select("doc_id"), "doc_id", "left_semi")
    ranked = ranked.withColumn("score", F.round(F.abs("bm25") / (1 + F.abs("bm25")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)
    out = top.join(facts, "doc_id")
    if collection:
        out = out.where(F.col("collection") == collection)
    out = out.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= limit) & (F.col("score") >= min_score))
    return out.select("query_id", "rank", "doc_id", "docid", "collection", "path", virtual_path(F.col("collection"), F.col("path")).alias("file"), "title", "score")
