"""Removed bytes against every 400-byte string of a table; merging and common prefixes against sorting."""

import hashlib
import random
from collections import Counter

from quillspark.llm import suffix_dedup as sd
from quillspark.llm.merging import common_prefix, front_code, front_decode, merge, merge_prefixes


def by_hand(texts, length=sd.MIN_BYTES):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting all its strings of ``length`` bytes."""
    rows = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def engine(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 7, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, h int, kept string, spans array<int>")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, **options).collect()}
    return [got[i] for i in range(len(texts))]


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_odd_texts(spark):
    rnd = random.Random(1)
    passage, other, accents = words(rnd, 120), words(rnd, 150), "éüß" * 150
    exact = passage[:400]
    texts = [
        None, "", "short", passage + " end of one", "start " + passage, words(rnd, 40) + passage[:399] + "#", "x" * 399, "y" * 400, "y" * 401, "ab" * 700,
        other + " | " + other, accents, "z" + accents, exact, exact, "q" + exact + "r", passage[:250] + other[:200], passage[100:500] + passage[90:490], "\n" * 900, "\U0001f600" * 120, "t" + "\U0001f600" * 120,
    ]
    assert engine(spark, texts) == by_hand(texts)


def test_near_surroundings(spark):
    """One passage among other words each time, cut at either end by turns: hundreds of suffixes under one gram."""
    rnd = random.Random(2)
    passage = words(rnd, 140)
    texts = [words(rnd, rnd.randrange(0, 30)) + passage[rnd.randrange(0, 300) : len(passage) - rnd.randrange(0, 300)] + words(rnd, rnd.randrange(0, 30)) for _ in range(300)]
    assert engine(spark, texts) == by_hand(texts)


def test_short_strings_many_ties(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 90))) for _ in range(150)] + ["a" * 60, "a" * 33, "ab" * 40]
    for length, gram in ((12, 4), (20, 8)):
        assert engine(spark, texts, length=length, gram=gram) == by_hand(texts, length)


def test_repeated_rows_and_ids(spark):
    text = words(random.Random(4), 100)
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "!"), (2, "own words")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [("1", len(text)), ("1", len(text)), ("2", 0), ("None", len(text))]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op6_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = by_hand([r.text for r in docs])
    assert [got[r.doc_id] for r in docs] == want and sum(w[1] > 0 for w in want) > 20


def test_merging():
    rnd = random.Random(5)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(0, 40))) for _ in range(9)] + [[]]
    coded = [front_code(r) for r in runs]
    assert all(front_decode(*c) == r for c, r in zip(coded, runs, strict=True))
    whole = [runs[i][j] for i, j in merge(runs)]
    assert whole == sorted(x for r in runs for x in r)
    last, out = b"", []
    for i, j, n in merge_prefixes([(r, c[0]) for r, c in zip(runs, coded, strict=True)]):
        x = runs[i][j]
        assert n == common_prefix(last, x) or not out
        out.append(x)
        last = x
    assert out == whole
