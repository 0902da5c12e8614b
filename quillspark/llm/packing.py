"""Best-fit packing: token pieces of documents laid into fixed-length sequences.

Documents are tokenised where they lie; only short rows of lengths move.  They
are dealt to shards of bounded size, and each shard is packed by vector best
fit: a piece needs tokens, a document slot and attention cost, and goes to the
open bin with room for all three that the chosen measure likes best.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, staged, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Pieces a shard holds on average.  More pieces to choose from waste less; each shard leaves at most a few bins part-filled.
SHARD_PIECES = 16_384
#: Distinct words whose ids a worker remembers; beyond that it forgets all but those it met first, frequent words among them.
CACHE_WORDS, CACHE_KEPT = 1_000_000, 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer at ``path`` and its worker's memory of words, loaded once a worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would wait for others' cores
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


#: A Latin word with marks behind it: the vocabulary's splitter always parts the two, and knows no capitals.  (U+0130 is left out: in lower case it ends in a combining dot, which the splitter keeps with marks.)
_MARKED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([-.,;:!?%&$#*()\[\]|/\"]+)")


def _learn(words: set[bytes], known: dict[bytes, bytes], tokenizer) -> None:
    """Adds the ids of ``words`` to ``known``; a word with marks behind it by way of its two parts."""
    parts: dict[bytes, tuple[bytes, bytes]] = {}
    ask: set[bytes] = set()
    for w in words:
        m = _MARKED.fullmatch(w.decode())
        if m:
            parts[w] = own = (m[1].lower().encode(), m[2].encode())
            ask.update(x for x in own if x not in known)
        else:
            ask.add(w)
    each = list(ask)
    for k in range(0, len(each), 4096):
        some = each[k : k + 4096]
        for w, got in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            known[w] = np.array(got.ids, "<u4").tobytes()
    for w, (a, b) in parts.items():
        known[w] = known[a] + known[b]


def token_bytes(text: str, path: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit numbers.

    This vocabulary drops white space before it merges, and no merge crosses
    it, so a text's ids are its words' ids in turn; each word is asked once.
    """
    tokenizer, known = _tokenizer(path)
    words = text.encode().split()  # at ASCII white space only
    try:
        return b"".join(map(known.__getitem__, words))
    except KeyError:
        if len(known) > CACHE_WORDS:
            for w in list(known)[CACHE_KEPT:]:
                del known[w]
        _learn({w for w in words if w not in known}, known, tokenizer)
        return b"".join(map(known.__getitem__, words))


def pieces(documents: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row for each piece of each document: its place among the document's ids, and their CRC-32.

    A null text is an empty one and has just the end id.  Documents of more
    than ``capacity`` ids are cut; each row of the input is a document of its
    own, also where keys repeat or are null.
    """
    ship(documents.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_bytes(t.as_py() or "", path) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, measure: str = "norm") -> np.ndarray:
    """The bin of each row of ``needs`` (already in the order to place them), by vector best fit.

    ``measure`` is "norm": least weighted norm of what would be left, or
    "dot": greatest weighted product of need and residual.  Equal bins: the
    oldest.  A row that no bin's residual admits in every dimension opens one.
    """
    if measure not in ("norm", "dot"):
        raise ValueError(f"measure {measure!r} is neither norm nor dot")
    if (needs > capacity).any():
        raise ValueError("a piece needs more than an empty bin has")
    scaled, w = needs / capacity, np.asarray(weights, float)
    out = np.empty(len(needs), np.int64)
    left = np.empty((1024, needs.shape[1]))
    names = np.empty(1024, np.int64)
    live = opened = 0
    for i, need in enumerate(scaled):
        room = left[:live]
        fits = np.flatnonzero((room >= need - 1e-12).all(axis=1))
        if len(fits):
            rest = room[fits]
            score = ((rest - need) ** 2 @ w) if measure == "norm" else -(rest @ (w * need))
            b = fits[int(np.argmin(score))]
            left[b] -= need
            out[i] = names[b]
            if (left[b] <= 1e-12).any():  # full in one dimension: closed
                live -= 1
                left[b:live], names[b:live] = left[b + 1 : live + 1].copy(), names[b + 1 : live + 1].copy()
        else:
            out[i] = opened
            if (need < 1 - 1e-12).all():
                if live == len(names):
                    left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
                left[live], names[live] = 1 - need, opened
                live += 1
            opened += 1
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, max_documents: int = CAPACITY, max_attention: int = CAPACITY * CAPACITY, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), measure: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The rows of :func:`pieces` with a sequence and a gapless offset in it.

    A sequence holds at most ``capacity`` tokens, ``max_documents`` pieces and
    ``max_attention`` attention cost (the sum of squared lengths).  Shards get
    rows by a hash of all columns, so no key gathers in one.
    """
    ship(rows.sparkSession)
    shards = max(1, -(-rows.count() // shard_pieces))
    limits = np.array([capacity, max_documents, max_attention], float)

    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        frame = frame.drop(columns="shard").sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        size = frame["length"].to_numpy(float)
        bins = best_fit(np.column_stack([size, np.ones(len(size)), size * size]), limits, np.array(weights), measure)
        frame["sequence_id"] = bins + (shard << 32)
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(placed, PLACED)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes."""
    return pack(staged(pieces(docs), "pieces"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows are documents of their own.
    """
    return pack_documents(spark, read_table(spark, sf_dir, "documents"), sf_dir)
