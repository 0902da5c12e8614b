"""Leaks planted word for word and as paraphrases; recall against brute force."""

import random

import numpy as np

from quillspark.llm import decontamination as d

SF = "/root/testdata/sf0.01"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert d.lcs_length(a, b) == slow_lcs(a, b)


def made_space(items):
    """A space without a corpus: all words weigh alike, and the basis is the words themselves."""
    spelled = [(i, d.tokens(t)) for i, t in items]
    words = {w: k for k, w in enumerate(sorted({w for _, t in spelled for w in t}))}
    n = len(words)
    holds = np.zeros((n + 1, len(spelled)), np.uint16)
    for k, (_, t) in enumerate(spelled):
        np.add.at(holds[:, k], [words[w] for w in t], 1)
    parts = np.array([h / np.linalg.norm(h) for h in holds[:-1].T.astype(np.float32)])
    basis = np.vstack([np.eye(n), np.zeros((1, n))]).astype(np.float32)
    sizes = np.array([len(t) for _, t in spelled])
    return d.Space(words, basis, np.append(np.ones(n), 0).astype(np.float32), spelled, np.arange(len(spelled)), parts, sizes, holds)


def test_passages_without_room_lose_nothing():
    """All passages against all items, with the check alone, find the same."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary[i : i + 35], k=rng.choice((8, 25, 90))))) for i in range(12)]
    space = made_space(items)
    found = 0
    for k in range(150):
        noise = ["none"] if k % 3 == 0 else vocabulary + ["none"] * 200
        text = rng.choices(noise, k=rng.choice((0, 5, 24, 70, 1500)))
        for _ in range(rng.randrange(4)):
            words = [w for w in rng.choice(items)[1].split() if rng.random() > 0.2]
            at = rng.randrange(len(text) + 1)
            text[at:at] = words
        text = " ".join(text)
        got = d.matches(text, space)
        own, ids = d._ids(text, space.words)
        # the sums of passages, word by word
        ends = -(-len(ids) // d.BLOCK)
        for p, v in enumerate(d._passages(ids, space) if own else ()):
            part = ids[p * d.BLOCK : (p + 2) * d.BLOCK] if ends > 1 else ids
            known = part[part < len(space.words)]
            want = space.basis[known].sum(axis=0) / max(1, len(known)) ** 0.5
            assert np.allclose(v, want, atol=1e-5)
        whole = d.Space(**{**vars(space), "holds": np.full_like(space.holds, 9999)})  # room for everything
        assert got.keys() == d.matches(text, whole).keys()
        for i, v in d.matches(text, whole).items():
            assert np.allclose(got[i], v, atol=1e-5)
        found += len(got)
    assert found > 100


def test_counts_by_strips_of_passages():
    rng = np.random.default_rng(1)
    strip, n = d.STRIP * d.BLOCK, 50
    for size in (0, 1, 23, 24, 25, 48, 49, strip, strip + 1, strip + d.BLOCK, strip + d.BLOCK + 1, 5000):
        ids = rng.integers(0, 70, size).astype(np.int32)
        ids[1000:1100] = n  # passages without a word
        ends = -(-size // d.BLOCK)
        slow = [ids[k * d.BLOCK : (k + 2) * d.BLOCK] for k in range(max(1, ends - 1) if ends else 0)]
        slow = [np.bincount(x[x < n], minlength=n).tolist() for x in slow if (x < n).any()]
        got = []
        for a in range(0, size, strip):
            places, tf = d._counts(ids[a : a + strip + d.BLOCK], n, a > 0)
            full = np.zeros((len(tf), n), int)
            full[:, places] = tf
            got += full.tolist()
        assert got == slow


def test_exact_copies_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(r.doc_id, i.item_id) for r in docs for i in items if i.text in r.text}
    got = {(r.doc_id, r.item_id): r for r in d.op10_decontamination(spark, SF).collect()}
    assert want and want <= set(got)
    text = {r.doc_id: r.text for r in docs}
    for (doc, item), r in got.items():  # nothing else but what holds most of an item in order
        words = d.tokens(next(i.text for i in items if i.item_id == item))
        assert slow_lcs(words, d.tokens(text[doc])) >= 0.6 * len(words)


def test_recall_of_paraphrases_and_clean_documents(spark):
    rng = random.Random(9)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    other = [w for t in docs for w in t.split()]
    planted = []
    for k, (i, text) in enumerate(items):
        words = [w if rng.random() > 0.12 else rng.choice(other) for w in text.split() if rng.random() > 0.06]
        host = docs[k].split(" ")
        at = rng.randrange(len(host))
        planted.append((1000 + i, " ".join(host[:at] + words + host[at:])))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)] + planted, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find(df, bench).where("lcs_share >= 0.6").collect()}
    brute = {(doc, i) for doc, t in planted for i, x in items if doc == 1000 + i and slow_lcs(d.tokens(x), d.tokens(t)) >= 0.75 * len(d.tokens(x))}
    assert len(got & brute) >= 0.9 * len(brute)


def test_odd_rows_and_stage(spark, tmp_path):
    item = "the seventh planet from the sun in our solar system is called by the name of uranus"
    clean = " ".join(f"word{i}" for i in range(500))
    schema = "doc_id long, text string, cosine double, row string"
    docs = spark.createDataFrame([(1, None, 0.0, "a"), (2, "", 0.0, "b"), (3, clean, 0.0, "c"), (3, clean + " " + item, 0.0, "d"), (4, item.upper(), 0.0, "e"), (None, item, 0.0, "f"), (5, "x " * 60_000 + item, 0.0, "g")], schema)
    spark.createDataFrame([(1, item), (2, None), (3, " . "), (None, "quite another question with no answer to be found here"), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = d.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == ["a", "b", "c"]
    assert d.find(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert d.drop_contaminated(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_recall_with_over_a_thousand_items(spark):
    rng = random.Random(12)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(600).collect() for w in d.tokens(r.text)]
    words = [w.decode() for w in words]
    items, rows = [], []
    for i in range(1200):
        at, other = (rng.randrange(len(words) - 60) for _ in range(2))
        own = words[at : at + 25]
        items.append((i, " ".join(own)))
        k = rng.randrange(23)
        around = words[other : other + 23]
        rows.append((i, " ".join(around[:k] + own + around[k:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in d.find(docs, spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert [i for i in range(1200) if got.get((i, i)) != 1.0] == []


def test_a_short_item_among_words_no_item_has(spark):
    filler = [(i, " ".join(f"f{(i * 7 + j) % 997}" for j in range(60)) + " of the cat sat on mat") for i in range(300)]
    planted = (1000, " ".join(f"u{j}" for j in range(20)) + " the cat sat on the mat " + " ".join(f"u{j}" for j in range(20, 60)))
    docs = spark.createDataFrame([*filler, planted], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "an unlike question about rivers and their names")], "item_id long, text string")
    assert (1000, 1) in {(r.doc_id, r.item_id) for r in d.find(docs, bench).where("contaminated").collect()}


def test_the_space_is_fitted_to_every_passage(spark, monkeypatch):
    """Counts of words together are those of all passages of all rows, also of more rows than a bounded sample would hold, and in several scans."""
    rng = random.Random(21)
    words = {w.encode(): k for k, w in enumerate(sorted(f"w{k}" for k in range(40)))}
    names = [w.decode() for w in words] + [f"other{k}" for k in range(60)]
    texts = [" ".join(rng.choices(names, k=rng.choice((0, 3, 24, 25, 60)))) for _ in range(13_000)] + [None, "", " ".join(rng.choices(names, k=30_000))]
    want, holds = np.zeros((40, 40), np.int64), np.zeros(40, np.int64)
    for t in texts:
        ids = np.array([words.get(w, 40) for w in d.tokens(t)], np.int64)
        ends = -(-len(ids) // d.BLOCK)
        holds += np.bincount(ids, minlength=41)[:40] > 0
        for k in range(max(1, ends - 1) if ends else 0):
            tf = np.bincount(ids[k * d.BLOCK : (k + 2) * d.BLOCK], minlength=41)[:40]
            want += np.outer(tf, tf)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(d, "COMMON", 25)
    for pair_counts in (d.PAIR_COUNTS, 15 * 40):
        together, seen, n = d._together(docs, words, "text", pair_counts)
        got = {r.w: np.frombuffer(bytes(r.row), np.int64) for r in together.collect()}
        assert n == len(texts) and (seen == holds).all() and (np.array([got[k] for k in range(40)]) == want).all()


def test_counts_are_handed_on_before_they_pass_32_bits(spark, monkeypatch):
    """A task that hands its counts on again and again ends with the same sums; and FULL passages of two words alone stay within 32 bits."""
    assert (d.FULL + d.STRIP + 1) * (2 * d.BLOCK) ** 2 < 2**31
    rng = random.Random(8)
    words = {f"w{k}".encode(): k for k in range(30)}
    docs = spark.createDataFrame([(" ".join(rng.choices([w.decode() for w in words], k=200)),) for _ in range(300)], "text string").coalesce(1)
    sums = []
    for full in (d.FULL, 20):
        monkeypatch.setattr(d, "FULL", full)
        together, seen, n = d._together(docs, words, "text")
        sums.append(({r.w: bytes(r.row) for r in together.collect()}, seen.tolist(), n))
    assert len(sums[0][0]) == 30 and sums[0] == sums[1]
    own, place = d._numbered(np.array([7, 2, 7, 30, 2], np.int32), 31)
    assert own.tolist() == [2, 7, 30] and place.tolist() == [1, 0, 1, 2, 0]
