"""Suffix-array de-duplication: removes every byte under a long string that occurs again.

Equal strings of MIN_BYTES bytes hold the same least 64-byte gram at the same
place, so it is enough to sort the suffixes at such anchors.  Anchors with
their whole surroundings equal are settled by counting.  The other suffixes
whose gram recurs are sorted in runs, exchanged front-coded, and merged with
loser trees that start comparing behind known common prefixes; the merged
order's common prefixes, and those of what precedes the anchors, tell exactly
which strings recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, staged
from .merging import common_prefix, front_code, front_decode, merge_prefixes

MIN_BYTES = 400
GRAM = 64
#: Strings looked at in one go, so that very long texts need bounded memory.
SEGMENT = 1 << 20
RUN_SUFFIXES = 20_000
#: Suffixes that one merging task gets on average.
MERGE_SUFFIXES = 40_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_powers: list[np.ndarray] = []


def _gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes of ``b``: polynomials modulo 2^64, mixed."""
    if not _powers or len(_powers[0]) < len(b):
        n = 1 << max(16, int(len(b)).bit_length())
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_BASE, _BACK)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * _powers[0][: len(b)])])
    g = (sums[size:] - sums[:-size]) * _powers[1][: len(b) - size + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of each ``width`` neighbours."""
    n = len(x) - width + 1
    fill = np.uint64(2**64 - 1) if least is np.minimum else np.uint64(0)
    rows = np.concatenate([x, np.full(-len(x) % width, fill, np.uint64)]).reshape(-1, width)
    before = least.accumulate(rows, axis=1).ravel()
    after = least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some string of ``length`` bytes; with ties, all of them."""
    width = length - gram + 1
    places, keys = [], []
    for s in range(0, len(data) - length + 1, SEGMENT):
        g = _gram_hashes(np.frombuffer(data, np.uint8)[s : s + SEGMENT + length - 1].astype(np.uint64), gram)
        least = _sliding(g, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == g)
        places.append(at + s)
        keys.append(g[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(keys)[first]


def anchor_rows(texts: DataFrame, length: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, p, key, around) for each anchor of each row of ``texts`` (doc_id, h, text): its place, gram hash, and a hash of all bytes that strings through it may hold."""
    ship(texts.sparkSession)
    left, right = length - gram, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = xxhash.xxh3_64_intdigest
        for b in batches:
            many, docs, hs, ps, ks, cs = 0, [], [], [], [], []
            for doc, h, t in zip(b.column("doc_id"), b.column("h"), b.column("text"), strict=True):
                data = (t.as_py() or "").encode()
                at, keys = anchors(data, length, gram)
                if len(at):
                    docs += [doc.as_py()] * len(at)
                    hs += [h.as_py()] * len(at)
                    ps.append(at)
                    ks.append(keys)
                    cs += [hashing(data[max(0, p - left) : p + right], min(p, left)) for p in at.tolist()]
                    many += len(at)
                if many > 200_000:
                    yield batch_of(docs, hs, ps, ks, cs)
                    many, docs, hs, ps, ks, cs = 0, [], [], [], [], []
            if many:
                yield batch_of(docs, hs, ps, ks, cs)

    def batch_of(docs: list, hs: list, ps: list, ks: list, cs: list) -> pa.RecordBatch:
        columns = [pa.array(docs, pa.int64()), pa.array(hs, pa.int64()), pa.array(np.concatenate(ps), pa.int64()), pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.array(cs, np.uint64).view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "p", "key", "around"])

    return texts.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, p long, key long, around long")


_RUN = "part int, shared array<int>, tails array<binary>, lefts array<binary>, h array<long>, p array<long>, single array<boolean>"
_RUN_SCHEMA = pa.schema([("part", pa.int32()), ("shared", pa.list_(pa.int32())), ("tails", pa.list_(pa.binary())), ("lefts", pa.list_(pa.binary())), ("h", pa.list_(pa.int64())), ("p", pa.list_(pa.int64())), ("single", pa.list_(pa.bool_()))])


def suffix_runs(texts: DataFrame, parts: int, length: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """Sorted, front-coded runs of the suffixes at given places of ``texts`` (h, text, at: array of p, key, single), parted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut() -> pa.RecordBatch:
            by: dict[int, list[tuple]] = {}
            for x in sorted(held):
                by.setdefault(x[4] % parts, []).append(x)
            held.clear()
            rows = []
            for part, own in by.items():
                shared, tails = front_code([x[0] for x in own])
                rows.append({"part": part, "shared": shared, "tails": tails, "lefts": [x[1] for x in own], "h": [x[2] for x in own], "p": [x[3] for x in own], "single": [x[5] for x in own]})
            return pa.RecordBatch.from_pylist(rows, _RUN_SCHEMA)

        for b in batches:
            for h, t, at in zip(b.column("h"), b.column("text"), b.column("at"), strict=True):
                data, h = t.as_py().encode(), h.as_py()
                for x in at.as_py():
                    p = x["p"]
                    held.append((data[p : p + length], data[max(0, p - length + gram) : p][::-1], h, p, x["key"], x["single"]))
                    if len(held) >= RUN_SUFFIXES:
                        yield cut()
        if held:
            yield cut()

    return texts.select("h", "text", "at").mapInArrow(run, _RUN)


def recurring(right: np.ndarray, lefts: list[bytes], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a sorted group, how far before its anchor strings begin that recur in the group: ranges of distances.

    ``right`` has the common prefix of each suffix with the one before it.  A
    string that begins ``d`` before the anchor recurs if another suffix shares
    ``length - d`` bytes with it, and the same one ``d`` bytes before the
    anchor: blocks of either sorted order, for each ``d`` where they change.
    """
    n, most = len(lefts), length - gram
    if n == 2:
        lo, hi = max(0, length - int(right[1])), min(most, common_prefix(*lefts))
        return [[(lo, hi)] if lo <= hi else []] * 2
    order = sorted(range(n), key=lefts.__getitem__)
    left = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    turns = np.unique(np.concatenate([[0], np.clip(length - right[1:], 0, most + 1), np.clip(left[1:] + 1, 0, most + 1)]))
    turns = turns[turns <= most]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, d in enumerate(turns.tolist()):
        end = int(turns[i + 1]) - 1 if i + 1 < len(turns) else most
        a, b = right < length - d, left < d
        a[0] = b[0] = True
        both = np.cumsum(a) * (n + 1) + np.cumsum(b)[rank]
        _, which, counts = np.unique(both, return_inverse=True, return_counts=True)
        for j in np.flatnonzero(counts[which] > 1).tolist():
            if out[j] and out[j][-1][1] == d - 1:
                out[j][-1] = (out[j][-1][0], end)
            else:
                out[j].append((d, end))
    return out


def merged_covers(runs: DataFrame, length: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(h, a, b): byte ranges under recurring strings, from the runs of :func:`suffix_runs`."""
    schema = pa.schema([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def merged(table: pa.Table) -> pa.Table:
        own = [r for r in table.to_pylist() if r["tails"]]
        items = [front_decode(r["shared"], r["tails"]) for r in own]
        out: list[tuple[int, int, int]] = []
        group: list[tuple[int, int]] = []
        right: list[int] = []

        def solve() -> None:
            if len(group) > 1 and any(own[i]["single"][j] for i, j in group):
                ranges = recurring(np.array(right), [own[i]["lefts"][j] for i, j in group], length, gram)
                for (i, j), found in zip(group, ranges, strict=True):
                    if own[i]["single"][j]:
                        h, p = own[i]["h"][j], own[i]["p"][j]
                        out.extend((h, p - hi, p - lo + length) for lo, hi in found)

        for i, j, n in merge_prefixes([(x, r["shared"]) for x, r in zip(items, own, strict=True)]):
            if n < gram and group:
                solve()
                group, right = [], []
            group.append((i, j))
            right.append(n)
        solve()
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return runs.groupBy("part").applyInArrow(merged, "h long, a long, b long")


def covers(documents: DataFrame, length: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(h, spans) for each text of ``documents`` (doc_id, h, text) with recurring strings; h is a 64-bit hash of the text.

    Copies are settled by counts that combine before they are shuffled: only
    one suffix of each (gram, surroundings) reaches the sort, and only if its
    gram also has other surroundings.
    """
    found = staged(anchor_rows(documents, length, gram), "anchors")
    kinds = staged(found.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("h", "p", "doc_id")).alias("rep")), "anchor-kinds")
    various = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    sort = kinds.join(various, "key").select(F.col("rep.h").alias("h"), F.col("rep.doc_id").alias("d"), F.struct(F.col("rep.p").alias("p"), "key", (F.col("n") == 1).alias("single")).alias("x"))
    sort = staged(sort.groupBy("h", "d").agg(F.collect_list("x").alias("at")), "to-sort")
    parts = max(1, -(-(sort.agg(F.sum(F.size("at"))).first()[0] or 0) // MERGE_SUFFIXES), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = documents.select("doc_id", "h", "text").join(sort.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d")))
    one = merged_covers(suffix_runs(texts.select("h", "text", "at"), parts, length, gram), length, gram)
    copies = kinds.where("n > 1").select("key", "around")
    sure = found.join(copies, ["key", "around"]).select("h", F.greatest(F.col("p") - (length - gram), F.lit(0)).alias("a"), (F.col("p") + length).alias("b"))
    return sure.unionByName(one).groupBy("h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id", length: int = MIN_BYTES, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row (and the bytes that are left, if asked for).

    Texts are UTF-8 bytes, null ones empty.  Every byte under a string of
    ``length`` bytes that also starts elsewhere, in any row, goes; rows that
    are wholly equal are copies of each other like any others.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    found = staged(covers(rows, length, gram), "covers")
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans"), strict=True):
                data = (t.as_py() or "").encode()
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for s in sorted((x["a"], min(x["b"], len(data))) for x in spans.as_py() or ()):
                    if s[0] > end:
                        if end >= 0:
                            at = end
                        kept.append(data[at : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                kept.append(data[max(end, 0) :])
                left = b"".join(kept)
                out.append((doc.as_py(), len(data), removed, runs, hashlib.sha256(left).hexdigest(), left if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(found, "h", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; rows that are wholly equal are copies of each other.
    """
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
