"""SimHash near-duplicates by segment popcounts.

A fingerprint's segments become bit counts.  The Manhattan distance of two
such vectors never exceeds the Hamming distance, so pairs within the radius
meet in a grid over them: whatever the radius, some blocks of segments agree
exactly, and each choice of blocks is a grid cell.  In a cell, pairs are
sifted by Manhattan distance and verified by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, ship, staged
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
#: Documents of which one stays: shingles of five words, as sets, and their exact similarity.
SET_SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Their fingerprints have so many words of 64 bits.  At similarity 0.8 some 19 of 128 bits differ, and more than 36 in one of ten thousand pairs.
WIDE, WIDE_RADIUS = 2, 36
#: A wide cell is a choice of segments, few enough that so many rows meet in it by chance; there are as many choices as bring RECALL of the pairs at SIMILARITY together.
CELL_ROWS, RECALL = 64, 0.995
#: Cells of up to so many rows are compared in one step.
AT_ONCE = 256
#: Rows of other components that a row looks for in a cell at first.
FIRST_REACH = 64
#: Segments of two bits: as many values as matter, and the tightest bound short of the bits themselves.
SEGMENTS = 32
_PAIRS_A_ROW = 64
_LOW = np.uint64(0x5555555555555555)
#: Rows of a cell compared with the rest of it at a time.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle of ``text``; none without words.

    A-Z are lower-cased; words are parted by ASCII white space.  A text of
    fewer words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    hashing = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((hashing(joined[a:b], 42) for a, b in spans), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of ``text``: a bit is set if it is in over half of the hashes of its word shingles, repeats counted; 0 without words."""
    return majority(shingle_hashes(text, size))


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """WIDE SimHashes of one set of shingles; all but the first over hashes mixed anew."""
    out = [majority(shingles)]
    for k in range(1, WIDE):
        x = (shingles ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(x ^ (x >> np.uint64(32))))
    return out


def fingerprints(documents: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), size: int = SHINGLE_WORDS) -> DataFrame:
    """The columns ``carry`` and fp (the fingerprint as a signed long) of every row."""
    ship(documents.sparkSession)
    rows = documents.select(F.col(text).alias("__text"), *carry)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), size) for t in b.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got.view(np.int64))], [*carry, "fp"])

    return rows.mapInArrow(run, schema)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """Two bits a segment: how many of the segment's two bits are set (0, 1 or 2)."""
    fp = fp.astype(np.uint64)
    return (fp & _LOW) + ((fp >> np.uint64(1)) & _LOW)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of packed popcounts: those differ by 2 where one has 10 and the other 00."""
    x = a ^ b
    two = (x >> np.uint64(1)) & _LOW & ~(x & _LOW) & ((a & _LOW) | (b & _LOW) ^ _LOW)
    one = x & _LOW
    return np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """The fewest blocks for which a row meets few others by chance; any number from radius + 1 on finds all pairs.

    A segment of random bits has 1.5 bits of information; ``b - radius`` of
    ``b`` blocks agree in a cell.
    """
    for b in range(radius + 2, 2 * radius + 6):
        if comb(b, radius) * rows / 2 ** (1.5 * SEGMENTS * (b - radius) / b) <= _PAIRS_A_ROW:
            return b
    return 2 * radius + 5


def cells(fps: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """(cell, fp): every grid cell of every row of ``fps`` (fp)."""
    edges = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    block_bits = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(block_bits[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = popcounts(fp)
            for i, mask in enumerate(masks):
                cell = (counts & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
                cell = (cell ^ (cell >> np.uint64(29)) ^ np.uint64(i * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64))], ["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def _near(fp: np.ndarray, counts: np.ndarray, i: int, rest: np.ndarray, radius: int) -> np.ndarray:
    """Which of the rows ``rest`` are within ``radius`` of row ``i``; sifted by Manhattan, verified by Hamming distance."""
    out = np.zeros(len(rest), bool)
    near = np.flatnonzero(_manhattan(counts[rest], counts[i]).sum(1) <= radius)
    out[near[np.bitwise_count(fp[rest[near]] ^ fp[i]).sum(1, dtype=np.int64) <= radius]] = True
    return out


def forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that connect the rows of one cell as all its pairs within ``radius`` do, fewer than rows.

    A row is compared with those that nothing has reached yet, so a dense
    group costs about as many comparisons as it has rows.
    """
    fp = fp.reshape(len(fp), -1)
    counts = popcounts(fp)
    unseen = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while len(unseen) > 1:
        front, unseen = [int(unseen[0])], unseen[1:]
        while front and len(unseen):
            i = front.pop()
            reached = np.concatenate([_near(fp, counts, i, unseen[k : k + _BLOCK], radius) for k in range(0, len(unseen), _BLOCK)])
            found = unseen[reached].tolist()
            out += [(i, j) for j in found]
            front += found
            unseen = unseen[~reached]
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose closure is that of all pairs within ``radius``.

    A cell emits a spanning forest, never all its pairs.  Cells meet by a
    shuffle and a sort, and are streamed: no task holds more than one cell.
    """
    ship(fps.sparkSession)
    placed = cells(fps, blocks_for(fps.count(), radius), radius)
    alone = placed.repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_cell, carry = None, np.empty(0, np.uint64)
        out: list[tuple[int, int]] = []

        def solve(fp: np.ndarray) -> None:
            if len(fp) == 2:
                if int(fp[0] ^ fp[1]).bit_count() <= radius:
                    out.append((fp[0], fp[1]))
            elif len(fp) > 2:
                out.extend((fp[i], fp[j]) for i, j in forest(fp, radius))

        def emitted() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(cell):
                continue
            cuts = np.flatnonzero(np.diff(cell)) + 1
            bounds = np.concatenate([[0], cuts, [len(cell)]])
            sizes = np.diff(bounds)
            last = len(sizes) - 1
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last)).tolist():
                part = fp[bounds[g] : bounds[g + 1]]
                if g == 0 and carry_cell == cell[0]:
                    part = np.concatenate([carry, part])
                elif g == 0:
                    solve(carry)
                if g == last:
                    carry_cell, carry = cell[-1], part.copy()
                else:
                    solve(part)
            yield emitted()
        solve(carry)
        yield emitted()

    return alone.mapInArrow(run, "a long, b long").distinct()


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp) with component_id, the smallest doc_id that links lead to.

    Copies share one fingerprint before anything is compared.  Texts without
    words have fingerprint 0 and are linked like any others.  Null ids take
    part as documents but never name a component.
    """
    rows = staged(rows, "fingerprints")
    kinds = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    nodes = connected_components(links(kinds.select("fp"), radius))
    named = kinds.join(nodes, kinds.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "component").select("fp", "component_id")
    return rows.join(classes, "fp")


def wide_marks(documents: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id", "content"), size: int = SET_SHINGLE_WORDS) -> DataFrame:
    """The columns ``carry``, a hash of the row's set of shingles, and the words of its wide fingerprint."""
    ship(documents.sparkSession)
    rows = documents.select(F.col(text).alias("__text"), *carry)
    names = ["shingles", *(f"fp{k}" for k in range(WIDE))]
    schema = T.StructType([*rows.schema.fields[1:], *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.empty((len(names), b.num_rows), np.uint64)
            for i, t in enumerate(b.column(0)):
                own = np.unique(shingle_hashes(t.as_py(), size))
                got[:, i] = [xxhash.xxh64_intdigest(own.tobytes()), *wide_fingerprint(own)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x.view(np.int64)) for x in got)], [*carry, *names])

    return rows.mapInArrow(run, schema)


def wide_choices(rows: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Masks (choice, word) over popcounts: how many segments a cell has follows from ``rows``, how many choices there are from RECALL.

    A bit of two fingerprints differs with the chance acos(cosine) / pi; two
    bits have equal popcounts if neither differs, or both do in 01 and 10.
    """
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    equal = (1 - differ) ** 2 + differ**2 / 2
    size = int(np.clip(np.ceil(np.log2(max(rows, 1) / CELL_ROWS) / 1.5), 4, SEGMENTS))
    many = int(np.ceil(np.log(1 - RECALL) / np.log(1 - equal**size)))
    rng = np.random.default_rng(5)
    out = np.zeros((many, WIDE), np.uint64)
    for mask in out:
        for k in rng.choice(SEGMENTS * WIDE, size, replace=False).tolist():
            mask[k // SEGMENTS] |= np.uint64(3 << (2 * (k % SEGMENTS)))
    return out


def nearest_tree(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect the rows of one cell as all its pairs within ``radius`` do, over near pairs before farther ones."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    if len(fp) <= AT_ONCE:
        a, b, far = _near_pairs(fp, radius)
        order = np.argsort(far, kind="stable")
        edges = zip(a[order].tolist(), b[order].tolist(), strict=True)
    else:
        edges = (e for r in (radius // 3, 2 * radius // 3, radius) for e in forest(fp, r))
    for i, j in edges:
        x, y = root(i), root(j)
        if x != y:
            parent[x] = y
            out.append((i, j))
    return out


def _near_pairs(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i < j) of the rows of a small cell within ``radius``, and how far they are; sifted by Manhattan distance."""
    a, b = _triangle(len(fp))
    counts = popcounts(fp)
    near = np.flatnonzero(_manhattan(counts[a], counts[b]).sum(1) <= radius)
    a, b = a[near], b[near]
    far = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64)
    keep = far <= radius
    return a[keep], b[keep], far[keep]


@lru_cache(AT_ONCE + 1)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def between_labels(fp: np.ndarray, label: np.ndarray, radius: int, reach: int) -> list[tuple[int, int, bool]]:
    """(row, partner, whether these are all): for each row of one cell its ``reach`` nearest rows within ``radius`` that have another label.

    Rows with the cell's most frequent label look for nobody: whoever has another label looks for them.
    """
    kinds, many = np.unique(label, return_counts=True)
    if len(kinds) < 2:
        return []
    counts, out, looking = popcounts(fp), [], label != kinds[int(np.argmax(many))]
    if len(fp) <= AT_ONCE:  # in the end the same, but rows that nothing is near cost nothing
        a, b, _ = _near_pairs(fp, radius)
        other = label[a] != label[b]
        met = np.zeros(len(fp), bool)
        met[a[other]] = met[b[other]] = True
        looking &= met
    for i in np.flatnonzero(looking).tolist():
        others = np.flatnonzero(label != label[i])
        near = others[_near(fp, counts, i, others, radius)]
        if len(near):
            far = np.bitwise_count(fp[near] ^ fp[i]).sum(1, dtype=np.int64)
            chosen = near[np.argsort(far, kind="stable")[:reach]]
            out += [(i, j, len(near) <= reach) for j in chosen.tolist()]
    return out


def wide_links(classes: DataFrame, masks: np.ndarray, radius: int = WIDE_RADIUS, reach: int = 0) -> DataFrame:
    """Pairs (a, b, whole) of ``classes`` (shingles, label, fp0, ..) that may be similar, found in the grid cells of ``masks``.

    Without ``reach``: trees that connect each cell over its near pairs.  With
    it: each row's so many nearest rows of other labels; not ``whole`` if it has more.
    """
    ship(classes.sparkSession)
    names = [f"fp{k}" for k in range(WIDE)]
    columns = ["shingles", "label", *names]
    schema = f"cell long, {', '.join(f'{n} long' for n in columns)}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = popcounts(np.stack([b.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1))
            for i, mask in enumerate(masks):
                cell = np.full(len(counts), i * 0x632BE59BD9B4E019 & (2**64 - 1), np.uint64)
                for word in ((counts & mask) + np.uint64(1)).T:
                    cell = (cell ^ word) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *(b.column(n) for n in columns)], ["cell", *columns])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last cell of the batches before

        def solve(rows: pa.Table) -> pa.RecordBatch:
            cell, node, label = (rows[n].to_numpy() for n in ("cell", "shingles", "label"))
            fp = np.stack([rows[n].to_numpy().view(np.uint64) for n in names], axis=1)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            got = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    own = between_labels(fp[a:b], label[a:b], radius, reach) if reach else [(i, j, False) for i, j in nearest_tree(fp[a:b], radius)]
                    got += [(node[a + i], node[a + j], whole) for i, j, whole in own]
            pairs = np.array([x[:2] for x in got], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(1) if len(pairs) else pairs[:, 1]), pa.array([x[2] for x in got], pa.bool_())], ["a", "b", "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(cell, cell[-1]))
            if last or (held and held[0].column("cell")[0].as_py() != cell[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield solve(pa.Table.from_batches(held))

    placed = classes.select(*columns).mapInArrow(place, schema)
    met = placed.repartition("cell").sortWithinPartitions("cell", *names).mapInArrow(meet, "a long, b long, whole boolean")
    return met.groupBy("a", "b").agg(F.min("whole").alias("whole"))


def wide_components(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], first_reach: int = FIRST_REACH) -> DataFrame:
    """(node, component) of the ``classes`` (shingles, fp0, ..) that are linked by similarity; ``texts`` gives (shingles, text) of a table of (shingles).

    Trees of near pairs come first, and what passes the exact check is
    connected.  Then every class that has another one near looks for its
    nearest ones in other components, for four times as many each round, until
    a round leaves none out.  So each pair within the radius that shares a
    cell either lies in one component or has failed the exact check.
    """
    masks = wide_choices(classes.count())
    tested = staged(wide_links(classes.withColumn("label", F.col("shingles")), masks).select("a", "b"), "wide-pairs")
    near = staged(classes.join(tested.select(F.explode(F.array("a", "b")).alias("shingles")).distinct(), "shingles", "left_semi"), "wide-near")
    bodies = staged(shingle_sets(texts(near.select("shingles"))), "wide-sets")
    good, reach = staged(similar(tested, bodies), "wide-good"), first_reach
    while True:
        nodes = staged(connected_components(good), "wide-nodes")
        labelled = near.join(nodes, F.col("shingles") == F.col("node"), "left").withColumn("label", F.coalesce("component", "shingles"))
        found = staged(wide_links(labelled, masks, reach=reach), "wide-pairs")
        left_out = not found.where("not whole").isEmpty()
        fresh = staged(found.select("a", "b").join(tested, ["a", "b"], "left_anti"), "wide-pairs")
        passed = staged(similar(fresh, bodies), "wide-good")
        new = not passed.isEmpty()
        good, tested = good.unionByName(passed), tested.unionByName(fresh)
        if not left_out:
            return connected_components(good) if new else nodes
        reach *= 4


def shingle_sets(texts: DataFrame, size: int = SET_SHINGLE_WORDS) -> DataFrame:
    """(shingles, set): of each text (shingles, text) the sorted hashes of its shingles, eight bytes each."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), size)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("shingles"), pa.array(sets, pa.binary())], ["shingles", "set"])

    return texts.select("shingles", "text").mapInArrow(run, "shingles long, set binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (shingles, set) have that Jaccard similarity; pairs whose sizes rule it out never meet their sets."""
    ship(pairs.sparkSession)
    sizes = sets.select("shingles", (F.octet_length("set") / 8).alias("n"))
    near = pairs.join(sizes.select(F.col("shingles").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("shingles").alias("b"), F.col("n").alias("nb")), "b")
    near = near.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb")).select("a", "b")
    one, two = (sets.select(F.col("shingles").alias(e), F.col("set").alias(f"set_{e}")) for e in "ab")
    both = near.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document stays of each group of ``docs`` linked by a Jaccard similarity of 0.8 of their sets of five-word shingles.

    The one with the smallest id stays; if rows repeat it, the one with the
    least content hash.  Texts without words are alike.  Rows without an id
    are kept as they are.
    """
    content = F.xxhash64("text")
    named = docs.where("doc_id is not null").select("doc_id", "text", content.alias("content"))
    marks = staged(wide_marks(named), "wide-marks")
    kinds = ["shingles", *(f"fp{k}" for k in range(WIDE))]
    classes = staged(marks.groupBy(*kinds).agg(F.min(F.struct("doc_id", "content")).alias("first")), "wide-classes")

    def texts(wanted: DataFrame) -> DataFrame:
        one = wanted.join(classes, "shingles").select("shingles", F.col("first.doc_id").alias("d"), F.col("first.content").alias("c"))
        return named.join(one, (F.col("doc_id") == F.col("d")) & (F.col("content") == F.col("c"))).dropDuplicates(["shingles"]).select("shingles", "text")

    nodes = wide_components(classes, texts)
    heads = classes.join(nodes, F.col("shingles") == F.col("node"), "left").groupBy(F.coalesce("component", "shingles")).agg(F.min("first").alias("first"))
    keep = heads.select(F.col("first.doc_id").alias("__id"), F.col("first.content").alias("__content"))
    kept = docs.withColumn("__c", content).join(keep, (F.col("doc_id") == F.col("__id")) & (F.col("__c").eqNullSafe(F.col("__content"))), "left_semi").dropDuplicates(["doc_id", "__c"]).drop("__c")
    return kept.unionByName(docs.where("doc_id is null"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, fingerprint, component_id.

    Texts without words have fingerprint zero, linked like any other; rows with null ids take part
    but never name a component.
    """
    out = components(fingerprints(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
