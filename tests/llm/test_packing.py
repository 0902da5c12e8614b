"""Pieces against the tokenizer itself; bins within every limit and few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np

from quillspark.llm import packing
from quillspark.llm.common import tokenizer_path

TEXTS = [None, "", "   ", "Hello, world's <|endoftext|> it's 42", "Élan\u0301 ΣΑΣ\u2003wide\u00a0space\x1cunit", "a\x0bb\x0cc\r\nd", "word " * 9000, "\U0001f600" * 40, "İstanbul ßtraße", "x" * 30000, "e\u0301 \u0301 \u0308a"]


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id"), (3, "same id")], "doc_id long, text string").selectExpr("*", "1 as piece")
    got = defaultdict(list)
    for r in packing.pieces(docs).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted(got[i]) == want, text
    assert len(got[3]) == 2 and len(got[None]) == 1


def test_whole_texts_of_a_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert packing.token_bytes(r.text, tokenizer_path()) == np.array(t.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(tokenizer_path()), random.Random(11)
    letters = "abcXYZ0159'\u00dféÉŠšÑñİıŁłœǅǆΣσςأ中\u0301\u0307\u2019\u00b7ﬁ"
    marks = "-.,;:!?%&$#*()[]|/\"'_<>=+~`@^{}\\…«»"
    for x in ("İ[", "İ,", "İ.b", "aİ!", *(f"ab{chr(c)}{m}" for c in range(0xC0, 0x250) for m in "[.")):
        assert packing.token_bytes(x, tokenizer_path()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
    for _ in range(6000):
        x = " ".join("".join(rnd.choice(letters if rnd.random() < 0.7 else marks) for _ in range(rnd.randrange(1, 9))) for _ in range(3))
        assert packing.token_bytes(x, tokenizer_path()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_sequences(spark):
    out = packing.op5_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(bins) <= -(-total // 4096) * 1.01 + 1


def test_every_limit_holds(spark):
    rows = spark.createDataFrame([(i, 0, 0, 1 + i % 37, i) for i in range(500)], packing.PIECES)
    for measure in ("norm", "dot"):
        out = packing.pack(rows, 100, 6, 2500, (1.0, 0.5, 0.5), measure, 200).collect()
        assert len(out) == 500
        bins = defaultdict(list)
        for r in out:
            bins[r.sequence_id].append(r.length)
        assert all(sum(b) <= 100 and len(b) <= 6 and sum(x * x for x in b) <= 2500 for b in bins.values())
    assert packing.pack(rows.limit(0)).count() == 0
