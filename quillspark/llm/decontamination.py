"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors; document
frequencies are counted over all documents, and so is how often any two words
of items occur in one passage.  These counts are the TF-IDF matrix of all
passages times itself; a randomised SVD of it and of the items gives a latent
space.  Every passage of every document is compared there by cosine with every
item it has room for, and what comes close is checked word by word: the longest common subsequence of item and
passage, and whether the item's answer is there.  A passage has no room for an
item if the text around it lacks so many of the item's words that no common
subsequence could pass the check; so leaving it out loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, staged

#: Passages are two neighbouring blocks of so many words; long items are looked for in parts.
BLOCK = 24
PART, PART_STEP = 48, 24
#: The latent space has so many dimensions, and as many more as every item part needs to keep KEPT of its norm.
RANK, KEPT = 192, 0.95
#: So many counts of two words a task holds (four bytes each); more words of items are counted in several scans.
PAIR_COUNTS = 1 << 24
#: Counts among so many of the most frequent words lie together, where processors reach them soon.
COMMON = 256
#: Items that share a latent space: bounds its dimensions, and so what a task holds.
ITEM_BLOCK = 512
MIN_COSINE = 0.2
#: A passage that shares this much of an item in order contaminates; half as strict where the answer is there too.
FULL_SHARE, PARAPHRASE_SHARE = 0.8, 0.6
#: An item's answer is its last words, this share of them.
ANSWER_SHARE, ANSWER_FOUND = 0.2, 0.8
#: Around a candidate passage, stretches of this many item lengths are compared, one each fourth of an item: all of 1.25 lengths are wholly in one.
STRETCH = 1.5
#: Words are looked up for so many neighbouring passages together (for more where items are longer).
GROUP = 16
#: Words of so many passages are counted together.
STRIP = 16
#: In so many passages no count of two words passes 32 bits; after them a task hands its counts on.
FULL = (2**31 - 1) // (2 * BLOCK) ** 2 - STRIP - 1

_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
MATCHES = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII marks part words like white space."""
    return (text or "").lower().encode().translate(_TABLE).split()


def lcs_length(a: list, b: list) -> int:
    """The length of the longest common subsequence, a row of ``a`` at a time as bits of one number."""
    full = (1 << len(a)) - 1
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    row = full
    for y in b:
        m = masks.get(y)
        if m:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """Words with their place and weight, the latent basis times the weights, and the items in it."""

    words: dict[bytes, int]
    basis: np.ndarray  # a row for each word, and a zero row for all others
    squares: np.ndarray  # squared weights of the words, and 0 for all others
    items: list[tuple[int, list[bytes]]]
    part_item: np.ndarray
    parts: np.ndarray
    sizes: np.ndarray  # the number of words of each item
    holds: np.ndarray  # how often each item has each word, and a zero row for all other words


def _ids(text: str | None, words: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    own = tokens(text)
    get, none = words.get, len(words)
    return own, np.fromiter(map(get, own, repeat(none)), np.int32, len(own))


def _numbered(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of ``ids``, which are below ``n``, in order, and the place of each id among them; found by flags, without sorting."""
    there, place = np.zeros(n, bool), np.empty(n, np.intp)
    there[ids] = True
    distinct = np.flatnonzero(there)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[ids]


def _passages(ids: np.ndarray, space: Space) -> np.ndarray:
    """The latent vector of each passage of a text, over the norm of its TF-IDF vector (repeats in a passage aside).

    Words that no item has count for nothing: how much else a passage says
    must not hide the item in it.
    """
    known = np.flatnonzero(ids < len(space.words))
    places, own = _numbered(ids[known], len(space.words))
    blocks = -(-len(ids) // BLOCK)
    tf = np.bincount(known // BLOCK * len(places) + own, minlength=blocks * len(places)).reshape(blocks, len(places)).astype(np.float32)
    sums, norms = tf @ space.basis[places], tf @ space.squares[places]
    if blocks > 1:
        sums, norms = sums[:-1] + sums[1:], norms[:-1] + norms[1:]
    return sums / np.sqrt(np.where(norms > 0, norms, 1))[:, None]


def _rooms(ids: np.ndarray, space: Space, share: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Groups of passages (the first one's number, the end of its words) and the item parts they have room for.

    An item has room if ``share`` of its words are among those of the group's
    passages and an item length on both sides, which is all that the check reads.
    """
    longest, ends = int(space.sizes.max()), max(1, -(-len(ids) // BLOCK) - 1)
    step = max(GROUP, -(-longest // BLOCK))
    for a in range(0, ends, step):
        end = (min(a + step, ends) + 1) * BLOCK
        near, _ = _numbered(ids[max(0, a * BLOCK - longest) : end + longest], len(space.holds))
        room = space.holds[near].sum(axis=0, dtype=np.int32) >= share * space.sizes
        if room.any():
            yield a, end, np.flatnonzero(room[space.part_item])


def _counts(ids: np.ndarray, n: int, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """The words below ``n`` in ``ids``, and how often each is in each passage, passages without any left out.

    A single block is a passage of its own, unless ``more`` says that it is the end of a longer text.
    """
    at = np.flatnonzero(ids < n)
    places, own = _numbered(ids[at], n)
    blocks = -(-len(ids) // BLOCK)
    tf = np.bincount(at // BLOCK * len(places) + own, minlength=blocks * len(places)).reshape(blocks, len(places))
    if blocks > 1 or more:
        tf = tf[:-1] + tf[1:]
    return places, tf[tf.any(axis=1)]


def _together(documents: DataFrame, words: dict[bytes, int], text: str, pair_counts: int = PAIR_COUNTS) -> tuple[DataFrame, np.ndarray, int]:
    """(w, row): how often each word occurs together with each other in a passage, over all passages of all documents; the documents that hold each word, and how many documents there are.

    Two words that occur x and y times in a passage count x * y there.  Tasks
    return a row a word, and rows of one word are added after a shuffle.
    """
    n = len(words)
    own_rows = max(1, pair_counts // n)
    corner = min(COMMON, n) if own_rows >= n else 0
    rows = None

    def narrow(row: np.ndarray) -> bytes:
        return row.astype(np.uint16 if row.max() < 1 << 16 else np.int64).tobytes()

    for low in range(0, n, own_rows):
        high = min(n, low + own_rows)

        def counted(pairs: np.ndarray, common: np.ndarray, low: int = low, high: int = high) -> Iterator[pa.RecordBatch]:
            pairs = pairs.reshape(high - low, n)
            if corner:
                pairs[:corner, :corner], pairs[:corner, corner:] = common.reshape(corner, corner), pairs[corner:, :corner].T
            seen = np.flatnonzero(pairs.any(axis=1))
            for a in range(0, len(seen), 256):
                some = seen[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array((some + low).astype(np.int32)), pa.array([narrow(pairs[k]) for k in some], pa.binary())], ["w", "row"])
            pairs[:], common[:] = 0, 0

        def run(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high, counted=counted) -> Iterator[pa.RecordBatch]:
            pairs, common = np.zeros((high - low) * n, np.int32), np.zeros(corner * corner, np.int32)
            holds, many = np.zeros(n + 1, np.int64), 0
            for b in batches:
                for t in b.column(0):
                    _, ids = _ids(t.as_py(), words)
                    own, _ = _numbered(ids, n + 1)
                    holds[own[own < n]] += 1
                    holds[n] += 1
                    for a in range(0, len(ids), STRIP * BLOCK):
                        places, tf = _counts(ids[a : a + (STRIP + 1) * BLOCK], n, a > 0)
                        tf = tf.astype(np.float32)
                        first, last = np.searchsorted(places, (max(low, corner), high))
                        both = (tf.T @ tf).astype(np.int32)
                        at = (places[first:last, None] - low) * n + places
                        pairs[at.ravel()] += both[first:last].ravel()
                        if corner:
                            at = places[:first, None] * corner + places[:first]
                            common[at.ravel()] += both[:first, :first].ravel()
                        many += len(tf)
                        if many > FULL:
                            yield from counted(pairs, common)
                            many = 0
            if low == 0:  # the counts of documents take the place of a word before the first
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([holds.tobytes()], pa.binary())], ["w", "row"])
            yield from counted(pairs, common)

        part = documents.select(text).mapInArrow(run, "w int, row binary")
        rows = part if rows is None else rows.unionByName(part)

    def added(table: pa.Table) -> pa.Table:
        total = 0
        for r in table.column("row"):
            row = r.as_buffer()
            total = total + np.frombuffer(row, np.uint16 if row.size == 2 * n else np.int64).astype(np.int64)
        return pa.table({"w": table.column("w")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    rows = staged(rows.groupBy("w").applyInArrow(added, "w int, row binary"), "words-together")
    counts = rows.where("w < 0").first()
    holds = np.frombuffer(bytes(counts["row"]), np.int64) if counts else np.zeros(n + 1, np.int64)
    return rows.where("w >= 0"), holds[:-1].astype(float), int(holds[-1])


def _latent_basis(together: DataFrame, weights: np.ndarray, items: np.ndarray, rank: int, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix A of all passages and the items.

    Randomised range finding: tasks multiply the rows of A'A, which are the
    counts of words together times their weights, with a thin X, and X is made
    orthonormal between rounds.  Items weigh as much as all passages together,
    so that the space tells them apart.
    """
    n = len(weights)
    rank = min(rank, n)
    x = np.random.default_rng(seed).normal(size=(n, rank))
    for _ in range(rounds):
        x, _ = np.linalg.qr(x)

        def run(batches: Iterator[pa.RecordBatch], x: np.ndarray = x * weights[:, None]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = b.column("w").to_numpy()
                if len(w):
                    rows = np.array([np.frombuffer(r.as_buffer(), np.int64) for r in b.column("row")]) * weights[w][:, None]
                    own = rows[np.arange(len(w)), w] * weights[w]
                    yield pa.RecordBatch.from_arrays([b.column("w"), pa.array([y.tobytes() for y in rows @ x], pa.binary()), pa.array(own)], ["w", "y", "own"])

        y, total = np.zeros(x.shape), 0.0
        for r in sorted(together.mapInArrow(run, "w int, y binary, own double").collect()):
            y[r["w"]] = np.frombuffer(bytes(r["y"]))
            total += r["own"]
        x = y + max(1.0, total / len(items)) * (items.T @ (items @ x))
    q, _ = np.linalg.qr(x)
    return q


def _widened(basis: np.ndarray, items: np.ndarray, kept: float = KEPT) -> np.ndarray:
    """``basis`` and the fewest leading directions of what it leaves of the items (rows of norm 1), so that each keeps ``kept`` of its norm."""
    inside = items @ basis
    have = (inside**2).sum(1)
    if (have >= kept**2).all():
        return basis
    _, _, more = np.linalg.svd(items - inside @ basis.T, full_matrices=False)
    reached = (have[:, None] + np.cumsum((items @ more.T) ** 2, axis=1) >= kept**2).all(0)
    return np.linalg.qr(np.hstack([basis, more[: int(reached.argmax()) + 1].T]))[0]


def fit(documents: DataFrame, items: list[tuple[int, str | None]], text: str = "text", rank: int = RANK) -> Space | None:
    """The latent space for ``items``; None if they have no words."""
    ship(documents.sparkSession)
    spelled = [(i, tokens(t)) for i, t in items]
    spelled = [(i, t) for i, t in spelled if t]
    often = Counter(w for _, t in spelled for w in t)
    words = {w: k for k, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}  # frequent ones lie together
    if not words:
        return None
    together, seen, n = _together(documents, words, text)
    weights = np.log((n + 1) / (seen + 1)) + 0.1
    parts, owner = [], []
    for k, (_, t) in enumerate(spelled):
        for a in range(0, max(1, len(t) - PART_STEP), PART_STEP) if len(t) > PART else (0,):
            v = np.zeros(len(words))
            np.add.at(v, [words[w] for w in t[a : a + PART]], 1)
            v *= weights
            parts.append(v / np.linalg.norm(v))
            owner.append(k)
    matrix = np.array(parts)
    basis = _widened(_latent_basis(together, weights, matrix, rank), matrix)
    latent = matrix @ basis
    squares = np.append(weights, 0) ** 2
    rows = np.vstack([basis * weights[:, None], np.zeros((1, basis.shape[1]))])
    holds = np.zeros((len(words) + 1, len(spelled)), np.uint16 if max(len(t) for _, t in spelled) < 1 << 16 else np.int32)
    for k, (_, t) in enumerate(spelled):
        np.add.at(holds[:, k], [words[w] for w in t], 1)
    sizes = np.array([len(t) for _, t in spelled])
    return Space(words, rows.astype(np.float32), squares.astype(np.float32), spelled, np.array(owner), latent.astype(np.float32), sizes, holds)


def matches(text: str | None, space: Space, min_cosine: float = MIN_COSINE, share: float = PARAPHRASE_SHARE) -> dict[int, tuple[float, float, float]]:
    """For each item found in ``text``: cosine, share of its words in order, and share of its answer."""
    own, ids = _ids(text, space.words)
    if not own:
        return {}
    near: list[tuple[float, int, int]] = []
    for first, end, parts in _rooms(ids, space, share):
        cosine = _passages(ids[first * BLOCK : end], space) @ space.parts[parts].T
        at, which = np.nonzero(cosine >= min_cosine)
        near += zip(cosine[at, which].tolist(), (at + first).tolist(), parts[which].tolist(), strict=True)
    out: dict[int, tuple[float, float, float]] = {}
    tried: set[tuple[int, int]] = set()
    for c, p, q in near:
        k = int(space.part_item[q])
        item = space.items[k][1]
        m = len(item)
        lo, hi = max(0, p * BLOCK - m), min(len(own), (p + 2) * BLOCK + m)
        around = own[lo:hi]
        there = set(item).intersection(around)
        if sum(w in there for w in item) < share * m or (p, k) in tried:  # no common subsequence has more words
            continue
        tried.add((p, k))
        span, step = int(STRETCH * m) + 1, max(1, m // 4)
        best, best_at = 0, 0
        for a in range(0, max(1, len(around) - span + step), step):
            n = lcs_length(item, around[a : a + span])
            if n > best:
                best, best_at = n, a
        if best >= share * m:
            answer = item[-max(1, round(ANSWER_SHARE * m)) :]
            got = lcs_length(answer, around[best_at : best_at + span]) / len(answer)
            score = (c, best / m, got)
            if k not in out or score[1:] > out[k][1:]:
                out[k] = score
    return {space.items[k][0]: v for k, v in out.items()}


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", **limits) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, contaminated) for each item found in each row of ``documents``.

    Items are taken in blocks, each against all documents.  Null and empty
    texts and items match nothing; repeated rows are searched one by one.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text))
    numbered = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    blocks = -(-numbered.count() // ITEM_BLOCK)
    out = None
    for k in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        space = fit(documents, sorted(((r["i"], r["t"]) for r in part.collect()), key=repr), text, **limits)
        if space is None:
            continue
        shared = spark.sparkContext.broadcast(space)  # bounded by ITEM_BLOCK items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, i, *v) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, v in matches(t.as_py(), shared.value).items()]
                columns = list(zip(*got, strict=True)) if got else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = rows.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], MATCHES)
    bad = (F.col("lcs_share") >= FULL_SHARE) | ((F.col("lcs_share") >= PARAPHRASE_SHARE) & (F.col("answer_share") >= ANSWER_FOUND))
    return out.withColumn("contaminated", bad)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text holds no benchmark item; rows are told apart by id and text."""
    found = find(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text"), read_table(spark, sf_dir, "benchmark"), key="row")
    bad = found.where("contaminated").select(F.col("doc_id").alias("__row")).distinct()
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("__row"), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that contaminates: doc_id, item_id, cosine, lcs_share, answer_share, contaminated.

    Null and empty texts and items match nothing; repeated rows are searched one by one; an empty
    table gives no rows.
    """
    return find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")).where("contaminated")
