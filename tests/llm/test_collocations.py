"""Collocations against a plain count of all n-grams, and the quotient filter's round trip."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import collocations as C
from quillspark.llm import quotient_filter as Q

SCHEMA = "doc_id long, text string, lang string, f long, word string, ids string"


def plain(rows, least, longest=5, top=2000, cover=100):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        often = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        inside = Counter()
        for p, f in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], f)
        found = []
        for p, a in often.items():
            if 100 * inside[p] < cover * a:
                score, _, l, r = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(n=150, seed=4):
    rnd = random.Random(seed)
    words = ["der", "The", "the", "naïve", "a", "b", "\x1cx", "Éa", "日本", "it's", "rare%d"]
    rows = []
    for k in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(1, 60))]
        w = [x % rnd.randrange(500) if "%" in x else x for x in w]
        text = "".join(x + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?", "\x0b", "\x85", " "]) for x in w)
        rows.append((text, rnd.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \t", "en"), ("the der " * 3000, "en"), ("alone", None)]


@pytest.mark.parametrize(("least", "top", "cover", "sent"), [(5, 2000, 100, 10**6), (5, 7, 100, 0), (12, 2000, 60, 10**6)])
def test_against_plain_counts(spark, least, top, cover, sent):
    rows = texts()
    docs = spark.createDataFrame([(k, t, lang, 1, "x", "y") for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = C.collocations(docs, least=least, top=top, cover=cover, sent_words=sent).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, top=top, cover=cover)


def test_small_buffers_change_nothing(spark, monkeypatch):
    rows = texts(60, 9)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(C, "FLUSH_ENTRIES", 10)
    monkeypatch.setattr(C, "ROW_WORDS", 64)
    got = C.collocations(docs, least=4).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4)


def test_no_phrases(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 3, 10, 17, 22, 31])
def test_filter_gives_everything_back(n, bits):
    rng, layout = np.random.default_rng(n * bits), Q.Layout(n, bits)
    ids = [rng.integers(0, min(1 << bits, 12), 2000) for _ in range(n)]
    if bits == 31:
        ids[0][:5] = (1 << 31) - 1
    entries, want = Q.counted(ids, layout), Counter(zip(*(x.tolist() for x in ids), strict=True))
    shard_bits, stack = min(4, layout.widths[0]), Q.Stack(layout)
    for shard, at in Q.shards(entries, layout, shard_bits):
        back = Q.decode(Q.encode(entries, at, layout, shard_bits), shard, layout, shard_bits)
        assert all((a == b[at]).all() for a, b in zip(back.limbs, entries.limbs, strict=True))
        for _ in range(300):  # beyond a byte's count
            stack.add(back)
    total = stack.take()
    own = layout.unpack(layout.permute(total.limbs, back=True))
    assert dict(zip(zip(*(x.tolist() for x in own), strict=True), total.counts.tolist(), strict=True)) == {k: 300 * v for k, v in want.items()}


def test_large_counts_survive():
    layout = Q.Layout(2, 9)
    entries = Q.collect([Q.Entries([np.array([3], np.uint64), np.array([5], np.uint64)], np.array([1 << 40]))] * 3, layout)
    ((shard, at),) = Q.shards(entries, layout, 2)
    assert Q.decode(Q.encode(entries, at, layout, 2), shard, layout, 2).counts.tolist() == [3 << 40]
