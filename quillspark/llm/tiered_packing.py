"""Hierarchical packing of documents into windows of several context sizes.

A document is routed to the smallest context size that holds it.  From the
largest size down, each document of a size opens a window, whose gap is filled
from the shorter sizes: by one document of just that length, by two that make
it up, by the largest that fits, and by a cut only where nothing fits.  So
every window is full, and its length is a context size.  Tasks pack where the
texts lie, in buffers of bounded size; what does not fill a window goes on to
the next buffer, and the last remainder of a task is cut at powers of two.
Afterwards the sequences of each context size are dealt to step groups whose
attention costs are alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, ship, staged, tokenizer_path
from .packing import token_bytes

#: Context sizes, each a power of two.
TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
#: Tokens a task holds before it packs them.
BUFFER_TOKENS = 3_000_000
#: Tokens of a step group, and sequences of one context size among which groups are balanced.
STEP_TOKENS, SHARD_SEQUENCES = 64 * 4096, 16_384

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A part of a document: (document, start, length).
Item = tuple[int, int, int]


class Pool:
    """Items that wait for a window, by length."""

    def __init__(self, longest: int):
        self.items: list[list[Item]] = [[] for _ in range(longest + 1)]
        self.count = np.zeros(longest + 1, np.int64)

    def put(self, item: Item) -> None:
        self.items[item[2]].append(item)
        self.count[item[2]] += 1

    def take(self, length: int) -> Item:
        self.count[length] -= 1
        return self.items[length].pop()

    def largest(self, most: int) -> int:
        """The greatest length up to ``most`` that an item has, or 0."""
        found = np.flatnonzero(self.count[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def least(self, over: int) -> int:
        """The least length over ``over`` that an item has, or 0."""
        found = np.flatnonzero(self.count[over + 1 :])
        return int(found[0]) + over + 1 if len(found) else 0

    def pair(self, total: int) -> int:
        """The longer length of two items that make up ``total``, or 0."""
        low = np.arange(1, total // 2 + 1)
        both = (self.count[low] > 0) & (self.count[total - low] > (low * 2 == total))
        found = np.flatnonzero(both)
        return total - int(low[found[0]]) if len(found) else 0


def fill(pool: Pool, window: list[Item], gap: int) -> int:
    """Fills ``window`` from ``pool``; what is left of ``gap``, which is nothing unless the pool is used up."""
    while gap:
        if pool.count[gap]:
            window.append(pool.take(gap))
            return 0
        longer = pool.pair(gap)
        if longer:
            window += [pool.take(longer), pool.take(gap - longer)]
            return 0
        n = pool.largest(gap)
        if n:
            window.append(pool.take(n))
            gap -= n
            continue
        n = pool.least(gap)
        if not n:
            return gap
        doc, start, length = pool.take(n)
        window.append((doc, start, gap))
        pool.put((doc, start + gap, length - gap))
        return 0
    return 0


def pack_tiers(items: list[Item], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Item]], list[Item]]:
    """Full windows, each as long as one of ``tiers``, and the items of the one window that could not be filled."""
    windows: list[list[Item]] = []
    pool = Pool(tiers[0])
    for doc, start, length in items:
        while length > tiers[0]:
            windows.append([(doc, start, tiers[0])])
            start, length = start + tiers[0], length - tiers[0]
        pool.put((doc, start, length))
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (n := pool.largest(tier)) > below:
            window = [pool.take(n)]
            if fill(pool, window, tier - n):
                return windows, window
            windows.append(window)
    return windows, []


def cut_at_powers(items: list[Item]) -> list[list[Item]]:
    """``items`` as sequences whose lengths are the powers of two that make up their total, from the greatest down."""
    total, out, waiting = sum(x[2] for x in items), [], items[::-1]
    while total:
        size = gap = 1 << (total.bit_length() - 1)
        window = []
        while gap:
            doc, start, length = waiting.pop()
            window.append((doc, start, min(gap, length)))
            if length > gap:
                waiting.append((doc, start + gap, length - gap))
            gap -= min(gap, length)
        out.append(window)
        total -= size
    return out


def tiered_pieces(documents: DataFrame, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, path: str | None = None, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence is as long as a power of two of at most the first of
    ``tiers``, so none needs padding.  A null text is an empty one and has
    just the end id; each row of the input is a document of its own, also
    where keys repeat or are null.  A task's rows depend on its input alone,
    so a lost one is made again as it was.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError(f"context sizes must be falling powers of two, not {tiers}")
    ship(documents.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[tuple[int | None, bytes]] = []
        waiting: list[Item] = []

        def rows(windows: list[list[Item]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for window in windows:
                at = 0
                for doc, start, length in window:
                    name, own = ids[doc]
                    out.append((name, start, length, zlib.crc32(memoryview(own)[4 * start : 4 * (start + length)]), len(own) // 4, number, at))
                    at += length
                number += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        tokens = 0
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = token_bytes(t.as_py() or "", path) + end
                waiting.append((len(ids), 0, len(own) // 4))
                ids.append((name, own))
                tokens += len(own) // 4
                if tokens >= buffer_tokens:
                    windows, rest = pack_tiers(waiting, tiers)
                    yield rows(windows)
                    # whoever is left goes on with the tokens of its document
                    ids, waiting = [ids[doc] for doc, _, _ in rest], [(k, start, length) for k, (_, start, length) in enumerate(rest)]
                    tokens = sum(x[2] for x in waiting)
        windows, rest = pack_tiers(waiting, tiers)
        yield rows(windows + cut_at_powers(rest))

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(packed, PLACED)


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``pieces`` with context (the length of their sequence) and step_group.

    A step group has sequences of one context size only, ``step_tokens`` of
    them at most but for a group of its own shard's odd ones.  Sequences of a
    size are dealt to shards by hash, and within a shard to its groups to and
    fro in the order of their attention cost (the sum of squared lengths), so
    the groups of a shard cost nearly the same.
    """
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("context"), F.sum(F.col("length") * F.col("length")).alias("attention"))
    shards = F.broadcast(own.groupBy("context").agg(F.ceil(F.count("*") / shard_sequences).alias("shards")))  # a row a context size
    dealt = own.join(shards, "context").withColumn("shard", F.pmod(F.xxhash64("sequence_id"), F.col("shards")))
    shard = Window.partitionBy("context", "shard")
    dealt = dealt.withColumn("rank", F.row_number().over(shard.orderBy(F.desc("attention"), "sequence_id")) - 1).withColumn("groups", F.ceil(F.count("*").over(shard) * F.col("context") / step_tokens))
    turn = F.pmod("rank", 2 * F.col("groups"))
    at = F.when(turn < F.col("groups"), turn).otherwise(2 * F.col("groups") - 1 - turn)
    named = dealt.select("sequence_id", "context", F.concat_ws("-", "context", "shard", at.cast("long")).alias("step_group"))
    return pieces.join(named, "sequence_id")


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group.

    A null or empty text is its end id alone; repeated rows are documents of
    their own; an empty table gives no rows.
    """
    placed = step_groups(staged(tiered_pieces(read_table(spark, sf_dir, "documents")), "tiered"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")
