"""The whole pipeline on the smallest tables: each stage's decisions take effect."""

from collections import defaultdict

import corpus_pipeline
from quillspark.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "line_dedup":
            assert set(now) == set(before) and any(len(now[k]) < len(before[k]) for k in now)
        elif name != "quality_rules":
            assert all(now[k] == before[k] for k in now)
        before = now
    assert not [t for t in before.values() for x in items if x in t]
    packed = docs.sparkSession.createDataFrame(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_run_places_each_document_once(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)


def test_odd_rows_through_all_stages(spark):
    """Null and empty texts, null and repeated ids, copies, a very long text, and columns with names that stages use inside."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    good = next(r.text for r in rows if 150 < len(r.text.split()) < 400)
    unlike = "\n".join(f"Another {i} quite long line of its own, number {i * 7919 % 1000}, that tells what happened in year {1000 + i * 37 % 991}." for i in range(60))
    odd = [(9001, None), (9002, ""), (9003, " \n\n"), (None, unlike), (9004, unlike + " One more."), (9004, unlike + " One more."), (9005, good), (9006, good + " edited"), (9007, "\n".join(f"{unlike} variant {i}" for i in range(40)))]
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1, "c") for r in rows] + [(d, t, None, None, None, None, None, None) for d, t in odd]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, content string, fp long, id string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        before = docs.count()
        docs = staged(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == columns and docs.count() <= before
        left = docs.collect()
        if name == "quality_rules":
            assert not {9001, 9002, 9003} & {r.doc_id for r in left}, "texts without words fail the base rule"
        if name == "simhash":
            ids = [r.doc_id for r in left]
            assert ids.count(9004) <= 1 and len([t for t in ids if t is not None]) == len({t for t in ids if t is not None})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
