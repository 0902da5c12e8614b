"""Registered queries against their SQL, and closed-form cases of the search engine."""

import math
import os
import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.paths import glob_to_regex, handelize
from quillspark.operators import chunking, fulltext, fusion
from quillspark.functions import query_language as ql
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql_agree(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_bm25_is_what_sqlite_computes(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "omega"]
    docs = [(i, "c", f"p{i}.md", " ".join(rng.choices(words, k=2)), f"{i}" * 6, " ".join(rng.choices(words, k=rng.randrange(3, 30))), True) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, collection string, path string, title string, hash string, body string, active boolean")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(filepath, title, body, tokenize='unicode61')")
    con.executemany("insert into t(rowid, filepath, title, body) values (?, ?, ?, ?)", [(d[0], f"{d[1]}/{d[2]}", d[3], d[5]) for d in docs])
    cases = {1: ("alph", '"alph"*'), 2: ('"beta gamma"', '"beta gamma"'), 3: ("delta -omega", '"delta"* NOT "omega"*'), 4: ("gamma beta", '"gamma"* AND "beta"*')}
    got = {}
    for r in fulltext.bm25(df, fulltext.query_items(spark, [(k, q) for k, (q, _) in cases.items()])).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.bm25
    for k, (_, match) in cases.items():
        want = dict(con.execute("select rowid, bm25(t, 1.5, 4.0, 1.0) from t where t match ?", (match,)).fetchall())
        assert set(got.get(k, {})) == set(want)
        assert all(math.isclose(got[k][d], want[d], rel_tol=1e-9) for d in want)


def test_porter_is_what_sqlite_does(spark):
    from quillspark.functions.stemming import porter

    words = "caresses ponies caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes by say running connection generalizations oscillators".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        assert con.execute("select term from v").fetchall() == [(porter(w),)], w
    assert fulltext.search(spark, spark.createDataFrame([(1, "c", "p", "t", "h" * 8, "running connections", True)], "doc_id long, collection string, path string, title string, hash string, body string, active boolean"), [(1, "run connected")], stem=True).count() == 1


def test_query_language():
    shape = lambda q: [(x.tokens, x.prefix, x.negated) for x in ql.parse_lexical(q)]
    assert shape('Café -"two words" multi-agent don\'t') == [(("cafe",), True, False), (("two", "words"), False, True), (("multi", "agent"), False, False), (("don", "t"), True, False)]
    assert shape("-only -negated") == [] and shape("日本") == [(("日", "本"), False, False)] and shape('"open phrase') == [(("open", "phrase"), False, False)]
    doc = ql.parse_document("lex: a b\n\nVEC: what is it\nintent: x")
    assert [s[:2] for s in doc.searches] == [("lex", "a b"), ("vec", "what is it")] and doc.intent == "x" and ql.primary_query(doc.searches) == "a b"
    assert ql.parse_document("just words") is None and ql.parse_document("expand: words") is None
    for bad in ("a\nlex: b", "intent: x", "intent: x\nintent: y\nlex: z", 'lex: "open', "vec: a -b", "expand: a\nlex: b"):
        with pytest.raises(ValueError):
            ql.parse_document(bad)


def test_fusion_golden(spark):
    lists = spark.createDataFrame([(1, i, f, r, 1.0) for i, files in enumerate(("abc", "bca")) for r, f in enumerate(files, 1)], "query_id int, list_index int, file string, rank int, weight double")
    got = {r.file: r.score for r in fusion.fuse(lists).collect()}
    assert got == {"a": round(1 / 61 + 1 / 63 + 0.05, 9), "b": round(1 / 62 + 1 / 61 + 0.05, 9), "c": round(1 / 63 + 1 / 62 + 0.02, 9)}


def test_cutoff_and_chunks():
    assert chunking.best_cutoff([(100, 1), (150, 100), (180, 20)], 200, 100, []) == 150
    assert chunking.best_cutoff([(100, 90), (195, 20)], 200, 100, []) == 100
    assert chunking.best_cutoff([(10, 100)], 200, 100, []) == 200
    assert chunking.best_cutoff([(150, 100), (180, 20)], 200, 100, [(140, 160)]) == 180
    body = "wörter und mehr " * 800
    parts = chunking.chunks(body, overlap=0)
    assert "".join(t for _, t in parts) == body and all(len(t.encode()) <= 3600 for _, t in parts)
    lapped = chunking.chunks(body)
    assert all(body.encode()[p:].startswith(t.encode()) for p, t in lapped) and 2800 < len(lapped[0][1].encode()) <= 3600
    counted = chunking.chunks_by_tokens("x" * 9000, lambda t: len(t))
    assert all(n <= 900 for _, _, n in counted)
    assert chunking.code_break_points("import a\n\nclass B:\n    def c(self): pass\n", "x.py") == {0: 60, 10: 100, 23: 90}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(handelize(F.lit("a b/c___d e!.Md"))) == "a-b/c/d-e.Md" and one(handelize(F.lit("x/..."))) is None
    assert one(handelize(F.lit("\U0001f418.md"))) == "1f418.md" and one(handelize(F.lit("\U0001f418\U0001f389 party"))) == "1f418-1f389-party"
    import re

    assert re.fullmatch(glob_to_regex("src/{a,b}/**/*.md"), "src/a/x/y.md") and not re.fullmatch(glob_to_regex("*.md"), "a.txt")
    s = one(T.snippet(F.lit("one\ntwo\nneedle here\nfour\nfive"), F.lit("needle")))
    assert (s["line"], s["before"], s["after"], s["header"]) == (3, 1, 0, "@@ -2,4 @@ (1 before, 0 after)")
    assert one(T.is_docid(F.lit('"#abc123"'))) and not one(T.is_docid(F.lit("abc.md")))


def test_importing_without_spark():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
