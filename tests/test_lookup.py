"""Similar names, paths, folding, nearest neighbours by pivots, and break points of source files, against plain versions."""

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import paths as P
from quillspark.functions import text as T
from quillspark.functions.query_language import index_tokens
from quillspark.operators import lookup, nearest, pivots
from quillspark.operators.chunking import chunk_documents
from quillspark.operators.code_breaks import code_break_points


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("distance", "limit"), [(5, 5), (2, 3), (5, 1000), (0, 5)])
def test_similar_names(spark, distance, limit):
    rng = random.Random(distance + limit)
    names = ["", "a", "ab.md", "Notes/Été.md"] + ["".join(rng.choice("abcé/.") for _ in range(rng.randrange(1, 24))) for _ in range(250)]
    base = rng.sample(names, 25)
    asked = ["", "A"]
    for b in base:
        x = list(b)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(len(x) + 1)
            rng.choice([lambda: x.insert(k, rng.choice("abX")), lambda: x.__delitem__(slice(k, k + 1)), lambda: x.__setitem__(slice(k, k + 1), ["z"])])()
        asked.append("".join(x))
    docs = spark.createDataFrame([(n, True) for n in names] + [("gone.md", False)], "path string, active boolean")
    got = lookup.similar(docs, spark.createDataFrame([(q,) for q in [*asked, asked[0], None]], "query string"), distance, limit)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = []
    for q in set(asked):
        near = sorted((d, p.encode(), p) for p in set(names) if (d := levenshtein(p.lower(), q.lower())) <= distance)
        want += [(q, k + 1, p, d) for k, (d, _, p) in enumerate(near[:limit])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_did_you_mean(spark):
    docs = spark.createDataFrame([("notes", "guide.md", "a" * 64, True), ("notes", "sub/guild.md", "b" * 64, True), ("code", "main.rs", "c" * 64, True)], "collection string, path string, hash string, active boolean")
    roots = spark.createDataFrame([("notes", "/home/me/notes"), ("code", "C:\\src")], "name string, root string")
    asked = ["guid.md", "/home/me/notes/sub/guild.md:12", "C:\\src\\main.rs", "#aaaaaa", "#dddddd", "guide.md", "/home/me/other.md"]
    got = {r["query"]: tuple(r)[1:] for r in lookup.find_or_suggest(docs, spark.createDataFrame([(a,) for a in asked], "query string"), roots).collect()}
    assert got["guid.md"][:3] == ("none", None, None) and got["guid.md"][3] == ["guide.md", "main.rs", "sub/guild.md"]
    assert got["/home/me/notes/sub/guild.md:12"] == ("root", "notes", "sub/guild.md", []) and got["C:\\src\\main.rs"] == ("root", "code", "main.rs", [])
    assert got["#aaaaaa"][:3] == ("docid", "notes", "guide.md") and got["#dddddd"] == ("none", None, None, []) and got["guide.md"][0] == "suffix"
    assert got["/home/me/other.md"][0] == "none"


PATHS = [
    (["/a/b", "c"], "/x", "/a/b/c"), (["/a/b", "../c"], "/x", "/a/c"), (["/a", "/b"], "/x", "/b"), (["a"], "/x/y", "/x/y/a"), (["../.."], "/x", "/"), (["/a/./b//c/"], "/x", "/a/b/c"),
    (["C:\\a\\b", "..\\c"], "/x", "C:/a/c"), (["C:/a", "/b"], "/x", "/b"), (["/c/Users", "me"], "/x", "C:/Users/me"), (["/b/Users"], "/x", "/b/Users"), (["a", "D:/q"], "/x", "D:/q"),
    (["a"], "C:\\w", "C:/w/a"), (["/C/x", "../.."], "/x", "C:/"), ([""], "/x", "/x"), (["/d/x", "e", "/f/y"], "/x", "F:/y"), (["c:"], "/x", "c:/"),
]


def test_paths(spark):
    frame = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(PATHS)], "i int, parts array<string>, current string")
    got = {r.i: r.out for r in frame.select("i", P.resolve_path(F.col("parts"), F.col("current")).alias("out")).collect()}
    assert [got[i] for i in range(len(PATHS))] == [want for *_, want in PATHS]
    assert spark.range(1).select(P.resolve_path(F.array().cast("array<string>"), F.lit("/"))).first()[0] is None
    cases = [("/a/b/c", "/a", "b/c"), ("/a", "/a", ""), ("/ab", "/a", None), ("C:\\x\\y", "C:/x/", "y"), ("/a/b", "", None), ("/a/b", "/a/", "b")]
    rows = spark.createDataFrame([c[:2] for c in cases], "p string, q string").select(P.relative_to(F.col("p"), F.col("q"))).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases]
    assert [r[0] for r in spark.createDataFrame([("/a",), ("C:x",), ("a/b",), ("",), ("\\a",)], "p string").select(P.is_absolute_path(F.col("p"))).collect()] == [True, True, False, False, False]


def test_folding_is_that_of_the_usual_tokenizer(spark):
    """Every letter, number, mark and private character below the second plane, between two letters, against SQLite's unicode61."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    chars = [chr(c) for c in (*range(0x80, 0xD800, 1), *range(0xE000, 0x11000)) if unicodedata.category(chr(c))[0] in "LNM" or unicodedata.category(chr(c)) == "Co"]
    old = lambda c: unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c)  # noqa: E731  letters that all three sides are old enough to know
    chars = [c for c in chars if old(c)]
    con.executemany("insert into t(rowid, x) values (?, ?)", [(ord(c), f"q{c}q") for c in chars])
    want = {}
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    frame = spark.createDataFrame([(ord(c), f"q{c}q") for c in chars], "c int, x string")
    got = {r.c: list(r.t) for r in frame.select("c", T.tokens(F.col("x")).alias("t")).collect()}
    assert all(tuple(got[ord(c)]) == index_tokens(f"q{c}q") for c in chars), "queries are read like documents"
    wrong = [c for c in chars if unicodedata.category(c)[0] != "M" and got[ord(c)] != want[ord(c)]]
    newer = [c for c in wrong if got[ord(c)] == [f"q{c.lower()}q"] and want[ord(c)] == [f"q{c}q"]]  # capitals that got small letters later
    assert len(wrong) == len(newer), [(hex(ord(c)), got[ord(c)], want[ord(c)]) for c in wrong if c not in newer][:20]
    assert all(got[ord(c)] == want[ord(c)] for c in T.MARKS)
    assert got[ord("ấ")] == want[ord("ấ")] == ["qấq"] and got[ord("ǎ")] == ["qaq"] and got[ord("ſ")] == ["qsq"]


@pytest.mark.parametrize(("clusters", "spread", "share"), [(30, 0.05, 0.2), (1, 5.0, 1.01)])
def test_pivots_find_what_a_whole_scan_does(spark, clusters, spread, share):
    rng = random.Random(clusters)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(clusters)]
    rows = [(k, [x + rng.gauss(0, spread) for x in rng.choice(centers)], f"n{k}") for k in range(3000)]
    rows += [(3000, [0.0] * 12, "zero"), (3001, [1.0] * 5, "short"), (3002, [], "none"), (3003, list(rows[7][1]), "copy")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance_note string")
    asked = spark.createDataFrame([(k, rows[k * 20][1]) for k in range(40)] + [(90, [0.0] * 12), (91, [1.0, 2.0, 1.0, 1.0, 1.0])], "query_id long, query_vec array<float>")
    seen = []
    got = pivots.nearest_k(spark, pivots.build(vectors, many=40), asked, 10, seen)
    dense = nearest.distances(vectors, asked)
    from pyspark.sql.window import Window

    want = dense.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("r <= 10")
    key = lambda df: sorted(map(tuple, df.where("query_id < 90").select("query_id", "r", "vec_id", "distance").collect()))
    assert key(got) == key(want)
    few = {(r.query_id, r.vec_id) for r in got.where("query_id >= 90 and distance < 'Infinity'").collect()}
    assert few == {(91, 3001)}
    ordinary = []
    pivots.nearest_k(spark, pivots.build(vectors.where("vec_id < 3000"), many=40), asked.where("query_id < 40"), 10, ordinary).collect()
    read, total = map(sum, zip(*ordinary, strict=True))
    assert total == 40 * 3000 and read <= share * total
    assert pivots.nearest_k(spark, pivots.build(vectors.limit(0)), asked.limit(0), 3) is None


TS = """import { Database } from './db';
import type { User } from './types';
const dyn = import('x');
// class NotOne {}
const s = `class ${ { a: "}" }.a } function no() {}`;

interface AuthConfig {
  secret: string;
}

type UserId = string;
enum Role { Admin, User }

export class AuthService {
  private db = { get() { return 1 } };
  constructor(private db: Database) {}

  async authenticate(user: User, token: string): Promise<boolean> {
    if (token) { return /}\\/"function x(){/.test(token) }
    return session?.userId === user.id;
  }
  abstract missing(a: number): void;
}

export function hashPassword(password: string): string {
  return crypto.createHash('sha256').update(password).digest('hex');
}
const arrow = async (a: number): Promise<void> => { await a };
let plain = 5, f = function () { return 1 };
export default function () {}
"""
GO = """package main

import "fmt"

// func comment() {}
type AuthService struct {
    db *Database
}

func (s *AuthService) Authenticate(user User) bool {
    f := func(x int) int { return x }
    return `func raw() {}` == ""
}

func Map[T any](xs []T) []T { return xs }
"""
RS = """use std::collections::HashMap;
/* fn not() {} /* struct Nested; */ fn nor() {} */
#[derive(Debug)]
pub struct AuthService<'a> {
    db: &'a Database,
    f: fn(i32) -> i32,
}

impl AuthService {
    pub(crate) async fn authenticate(&self, user: &User) -> impl Fn() { let c = '{'; let r = r#"fn raw() {}"#; }
}

trait Authenticatable {
    type Item;
    fn validate(&self) -> bool;
    fn given(&self) -> bool { true }
}

enum Role {
    Admin,
}
pub type Id = u64;
mod inner { pub unsafe extern "C" fn call() {} }
"""
PY = '''import os
from typing import (
    Optional,
)
"""
class Doc: pass
def doc(): pass
"""

class AuthService:
    def __init__(self, db):
        self.db = db  # def no(): pass

    async def authenticate(self, user):
        return "def x(): pass"

@decorator
@other(1)
def decorated(): pass
broken(
'''


def starts(source, path):
    data = source.encode()
    return [(data[at:].decode().split("\n")[0][:24], score) for at, score in sorted(code_break_points(source, path).items())]


def test_typescript():
    got = starts(TS, "src/auth.ts")
    assert got == [
        ("import { Database } from", 60), ("import type { User } fro", 60), ("interface AuthConfig {", 100), ("type UserId = string;", 80), ("enum Role { Admin, User ", 80), ("export class AuthService", 90),
        ("class AuthService {", 100), ("get() { return 1 } };", 90), ("constructor(private db: ", 90), ("async authenticate(user:", 90), ("export function hashPass", 90), ("function hashPassword(pa", 90),
        ("const arrow = async (a: ", 90), ("export default function ", 90),
    ]
    assert not any("interface" in line for line, _ in starts(TS, "auth.js")) and starts("!!!@@@###", "x.ts") == starts("", "x.ts") == starts("class A {}", "x.md") == []
    assert [s for _, s in starts("export class Foo {}\nexport function bar() {}", "a.mts")] == [90, 100, 90, 90]
    assert starts("const Comp = () => <div>{x}</div>;\nclass B extends C<T> { m() {} }", "A.TSX") == [("const Comp = () => <div>", 90), ("class B extends C<T> { m", 100), ("m() {} }", 90)]


def test_go_rust_python():
    assert starts(GO, "auth.go") == [('import "fmt"', 60), ("type AuthService struct ", 80), ("func (s *AuthService) Au", 90), ("func Map[T any](xs []T) ", 90)]
    assert starts(RS, "auth.rs") == [
        ("use std::collections::Ha", 60), ("pub struct AuthService<'", 100), ("impl AuthService {", 100), ("pub(crate) async fn auth", 90), ("trait Authenticatable {", 100), ("fn given(&self) -> bool ", 90),
        ("enum Role {", 80), ("pub type Id = u64;", 80), ("mod inner { pub unsafe e", 100), ('pub unsafe extern "C" fn', 90),
    ]
    assert starts(PY, "auth.py") == [("import os", 60), ("from typing import (", 60), ("class AuthService:", 100), ("def __init__(self, db):", 90), ("async def authenticate(s", 90), ("@decorator", 90), ("def decorated(): pass", 90)]
    assert code_break_points("é = 1\nclass Ü: pass\n", "x.py") == {7: 100}


def test_source_files_are_cut_at_definitions(spark):
    body = "".join(f"function part{k}() {{\n" + "  work();\n" * 110 + "}\n" for k in range(6))
    docs = spark.createDataFrame([(1, "lib/a.js", body), (2, "lib/a.md", body)], "doc_id long, path string, body string")
    got = {}
    for r in chunk_documents(docs, overlap=0).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert "".join(got[1]) == "".join(got[2]) == body
    assert all(t.startswith("function part") for t in got[1]) and not all(t.startswith("function part") for t in got[2])
