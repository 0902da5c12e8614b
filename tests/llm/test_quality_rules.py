"""Quality statistics against plain Python, and the rule learner on a known split."""

import re
from collections import Counter

from quillspark.llm import quality_rules as q

TEXTS = [
    None, "", "   \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "ligne à ligne\nligne à ligne\n \nautre #$%& ***",
    "\x0bodd\x0cspaces\rhere joined", "A B! C!!\nA B! C!!\n\nA B! C!!", " ".join(str(i % 11) for i in range(400)), "word" * 5000,
    "p q r s t u v w p q r s t u v w p q r s t u v w z",
]


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in q.judge(docs, []).collect()}
    for i, t in enumerate(TEXTS):
        want = by_hand(t)
        assert got[i][:5] == want, t
        assert got[i][5] == (want[0] >= 20 and 100 * want[4] <= 30 * want[0])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in q.op8_quality_rules(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(text[r.doc_id])


def test_learns_a_conjunction():
    rows = [([i / 100, j / 100], 0 if i > 60 and j < 30 else 1) for i in range(0, 100, 3) for j in range(0, 100, 4)]
    rules = q.learn_rules(rows, ("a", "b"))
    assert rules and {c[0] for c in rules[0].conditions} == {"a", "b"} and rules[0].precision > 0.9
    assert q.learn_rules([], ("a", "b")) == [] and q.learn_rules([([1.0, 1.0], 1)] * 30, ("a", "b")) == []


def test_learned_rules_separate(spark):
    sf = "/root/testdata/sf0.01"
    out = q.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.2 * n[(0, False)]


def test_stage_keeps_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rule int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good, "en", "s", 5, 9), (1, good, "en", "s", 5, 9), (None, good, None, None, None, None), (2, None, "en", "s", 0, 1)], schema)
    out = q.filter_documents(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert q.filter_documents(spark, docs.limit(0), str(tmp_path)).count() == 0
