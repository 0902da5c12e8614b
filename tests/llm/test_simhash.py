"""Fingerprints and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.llm import components as c
from quillspark.llm import simhash as s


def by_hand(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, pairs):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows, radius=4):
    fp = np.array([f for _, f in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1).tolist()]
    root = closure(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, least[r]) for (d, _), r in zip(rows, root, strict=True))


def test_fingerprint():
    for t in (None, "", " \t\n", "one", "one two three", "A b C d", "É É é x\x0by\x0cz", "a b c d " * 50, "w" * 100_000, " ".join(map(str, range(20_000)))):
        for size in (4, 5):
            assert s.fingerprint(t, size) == by_hand(t, size)


def test_bound_is_exact_manhattan_and_below_hamming():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    parts = lambda x: np.array([[(int(v) >> 2 * i) & 3 for i in range(32)] for v in x])
    want = np.abs(parts(s.popcounts(a)) - parts(s.popcounts(b))).sum(1)
    assert (s._manhattan(s.popcounts(a), s.popcounts(b)) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


def test_links_of_planted_groups(spark, monkeypatch):
    rng = random.Random(7)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                f ^= 1 << b
    fps += [0, 0, 1, 15, 31, 2**64 - 1] + [12345 ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]
    rows = [(1000 - i, f) for i, f in enumerate(fps)]
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    for blocks in (5, 6, 9):
        monkeypatch.setattr(s, "blocks_for", lambda n, r, b=blocks: b)
        assert sorted((r.doc_id, r.component_id) for r in s.components(df).collect()) == brute(rows)


def test_whole_table(spark):
    rows = s.op1_simhash(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(int(r.fingerprint, 16) == by_hand(text[r.doc_id]) and len(r.fingerprint) == 16 for r in rows)
    assert sorted((r.doc_id, r.component_id) for r in rows) == brute([(r.doc_id, int(r.fingerprint, 16)) for r in rows])


def test_stage_keeps_one_and_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, a, "x"), (3, a, "y"), (3, a, "z"), (None, a, "n"), (7, None, ""), (8, "", ""), (9, "quite another text of some words", "")], "doc_id long, text string, fp string")
    out = s.keep_one(spark, docs, "")
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "9", "None"]
    assert s.keep_one(spark, docs.limit(0), "").count() == 0


def sets_by_hand(texts, size=5):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else {b""})
    return out


def near_by_hand(texts):
    """All pairs of similar texts, by way of an inverted index, and the group of each."""
    sets, where = sets_by_hand(texts), defaultdict(list)
    pairs = []
    for i, x in enumerate(sets):
        both = Counter(j for w in x for j in where[w])
        pairs += [(j, i) for j, n in both.items() if n / (len(x) + len(sets[j]) - n) >= s.SIMILARITY]
        for w in x:
            where[w].append(i)
    return pairs, closure(len(texts), pairs)


def test_stage_against_brute_force(spark):
    rng = random.Random(9)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    for t in [t for t in texts if 100 < len(t.split()) < 2000][:200]:  # near copies from just over 0.8 on
        words = t.split()
        for k in range(2):
            own = list(words)
            for _ in range(max(1, round(len(own) * rng.uniform(0, 0.024)))):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    pairs, group = near_by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in s.keep_one(spark, docs, "").collect()}
    want = set(group)
    assert len(pairs) > 400 and want <= kept, "a document without a similar one before it stays"
    print(f"{len(kept - want)} of {len(texts) - len(want)} near copies stay")
    assert len(kept - want) <= 0.02 * (len(texts) - len(want))


@pytest.mark.parametrize(("many", "edits"), [(600, 12), (1000, 8)])
def test_stage_on_dense_families(spark, many, edits):
    rng = random.Random(many + edits)
    base = [f"base{rng.randrange(10**9)}" for _ in range(150)]
    texts = [" ".join(f"other{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 120))) for _ in range(1000)]
    for _ in range(many):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(1, edits + 1)):
            own[k] = f"changed{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    _, group = near_by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in s.keep_one(spark, docs, "").collect()}
    want = set(group)
    print(f"{len(texts) - len(want)} must go, {len(kept - want)} of them stay, {len(want - kept)} go wrongly")
    assert want <= kept and len(kept - want) <= 0.01 * (len(texts) - len(want))


def test_rows_look_for_other_labels_only():
    rng = np.random.default_rng(3)
    fp = np.zeros((9, 2), np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (9, 2), dtype=np.uint64))
    label = np.array([1, 1, 1, 1, 2, 2, 3, 4, 4])
    got = s.between_labels(fp, label, 4, 100)
    assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(4, 9) for j in range(9) if label[i] != label[j]} and all(w for *_, w in got)
    some = s.between_labels(fp, label, 4, 2)
    assert len(some) == 10 and not any(w for *_, w in some)
    assert s.between_labels(fp[:4], label[:4], 4, 2) == []


def test_trees_connect_what_pairs_do():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (40, 2), dtype=np.uint64)) for _ in range(12)])
    for n, radius in ((480, 4), (480, 3), (200, 4)):
        rows = fp[:n]
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if int(np.bitwise_count(rows[i] ^ rows[j]).sum()) <= radius]
        assert closure(n, s.nearest_tree(rows, radius)) == closure(n, pairs) == closure(n, s.forest(rows, radius))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(250)] + [(7, 7), (5, 6)]
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    want = [nodes[r] for r in closure(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])]
    got = {r.node: r.component for r in c.connected_components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == dict(zip(nodes, want, strict=True))
    assert c.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
