"""Held-out accuracy of the positive-unlabelled classifier, and its parts."""

import zlib

import numpy as np

from quillspark.llm import quality_classifier as q

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    rows = q.op3_quality_classifier(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [p for y, p in held if y], [p for y, p in held if not y]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.3


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    pos = rng.normal(1.5, 1, (2000, 4))
    mixed = np.concatenate([rng.normal(1.5, 1, (1800, 4)), rng.normal(-1.5, 1, (1200, 4))])
    model = q.fit(pos, mixed)
    assert abs(model.prior - 0.6) < 0.12
    s = model.score(mixed)
    assert (s[:1800] > 0.5).mean() > 0.95 and (s[1800:] < 0.5).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "a b", 3.0), (2, "w " * 100_000, 4.0)], "doc_id long, text string, score double")
    assert [r.score for r in q.score(docs, None).collect()] == [0.5] * 4
    model = q.fit(np.random.default_rng(1).normal(size=(50, q.DENSE + q.SHAPES)), np.random.default_rng(2).normal(size=(50, q.DENSE + q.SHAPES)))
    assert q.score(docs, model).count() == 4 and q.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.train(docs, labels) is None
