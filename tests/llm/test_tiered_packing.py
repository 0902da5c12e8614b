"""Tiered packing: every id once, no padding, and step groups of like cost."""

import random
import zlib

import numpy as np
import pytest

from quillspark.llm import tiered_packing as P
from quillspark.llm.common import tokenizer_path


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, P.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(40))
def test_windows_are_full_and_hold_everything_once(seed):
    rnd = random.Random(seed)
    longest = rnd.choice([1, 3, 50, 600, 5000, 20000])
    items = [(k, 0, rnd.randint(1, longest)) for k in range(rnd.randrange(0, 400))]
    windows, rest = P.pack_tiers(items)
    assert all(sum(x[2] for x in w) in P.TIERS for w in windows)
    last = P.cut_at_powers(rest)
    assert len(last) <= 12
    parts = {}
    for w in windows + last:
        total = sum(x[2] for x in w)
        assert total & (total - 1) == 0 and total <= P.TIERS[0]
        for doc, start, length in w:
            assert length > 0
            parts.setdefault(doc, []).append((start, length))
    for doc, _, length in items:
        at = 0
        for start, n in sorted(parts.pop(doc)):
            assert start == at
            at += n
        assert at == length
    assert not parts


def test_whole_documents_fill_a_window_before_any_is_cut():
    windows, rest = P.pack_tiers([(0, 0, 3000), (1, 0, 700), (2, 0, 396), (3, 0, 90)])
    assert sorted(windows[0]) == [(0, 0, 3000), (1, 0, 700), (2, 0, 396)] and rest == [(3, 0, 90)]


@pytest.mark.parametrize("buffer", [1, 3000, 10**7])
def test_pieces(spark, buffer):
    rnd = random.Random(buffer)
    texts = [" ".join(rnd.choice(["Ab", "cde.", "日本語", "x9", "İ"]) for _ in range(rnd.choice([0, 1, 30, 900, 9000]))) for _ in range(60)] + [None, "", " \n", "same", "same"]
    docs = spark.createDataFrame([(None if k == 3 else k % 50 + 100 * (k > 50), t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, start string, length int").repartition(4)
    got = P.tiered_pieces(docs, buffer_tokens=buffer).toPandas()
    by_sequence = got.groupby("sequence_id")["length"].sum()
    assert all(x & (x - 1) == 0 and x <= 4096 for x in by_sequence)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    ids = {}
    for (k, t), own in zip([(None if k == 3 else k % 50 + 100 * (k > 50), t) for k, t in enumerate(texts)], reference_ids(texts), strict=True):
        ids.setdefault(k, []).append(own)
    assert got["length"].sum() == sum(len(x) for own in ids.values() for x in own)
    for doc, start, length, crc, size in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
        own = [x for x in ids[None if np.isnan(doc) else int(doc)] if len(x) == size]
        assert any(zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for x in own)


def test_step_groups_are_balanced(spark):
    rnd = random.Random(2)
    rows = []
    for s in range(900):
        context = rnd.choice([512, 1024])
        cuts = sorted(rnd.sample(range(1, context), 3))
        rows += [(s, b - a, a) for a, b in zip([0, *cuts], [*cuts, context], strict=True)]
    pieces = spark.createDataFrame(rows, "sequence_id long, length long, offset long")
    got = P.step_groups(pieces, step_tokens=16 * 1024).toPandas()
    assert len(got) == len(rows) and (got.groupby("sequence_id")["length"].sum() == got.groupby("sequence_id")["context"].first()).all()
    groups = got.assign(cost=got["length"] ** 2).groupby("step_group").agg(tokens=("length", "sum"), cost=("cost", "sum"), sizes=("context", "nunique"), context=("context", "first"))
    assert (groups["sizes"] == 1).all() and (groups["tokens"] <= 17 * 1024).all()
    for _, own in groups.groupby("context"):
        mean = own["cost"] / own["tokens"]
        assert mean.max() < 1.1 * mean.min()


def test_empty_table_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.step_groups(P.tiered_pieces(empty)).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        P.tiered_pieces(empty, tiers=(4096, 1000))
