"""Phrase collocations, mined from exact counts of n-grams in counting quotient filters.

1. Words are counted for each language; those frequent enough get ids.
2. Texts are rewritten as ids, 0 for a break or a rare word.
3. Tasks count their bigrams in quotient filters (:mod:`quotient_filter`); a
   filter goes to the shards of its quotients, where sorted filters are merged
   and the frequent entries are given back.  An n-gram is one entry a task,
   however frequent it is, and shards are alike in size, for the permutation
   spreads all n-grams.
4. Three to five words are counted in the same way, but only where each pair
   in them hits a bit map of the frequent bigrams.  The map has a fixed size;
   when it fills up it spares less work and changes no count.
5. Cuts, scores and the phrases that longer ones cover are joins and groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quotient_filter as Q
from .common import read_table, ship, staged

MIN_COUNT, LONGEST, TOP, COVER_PERCENT, NO_LANGUAGE = 100, 5, 2000, 100, "und"
#: Distinct words a task counts before it gives its counts away, and entries of a filter likewise.
FLUSH_WORDS, FLUSH_ENTRIES = 400_000, 1_000_000
#: A dictionary of at most so many words, and words of so many bytes together, is sent to every task; a larger one is joined.
SENT_WORDS, SENT_BYTES = 1_000_000, 16_000_000
#: Ids are dealt by so many groups of words, so that no task numbers all words.
ID_GROUPS = 64
#: Words a row of ids holds, and words a shard of the filters gets of all.
ROW_WORDS, SHARD_WORDS = 1 << 18, 1_000_000
LEAST_SHARD_BITS, MOST_SHARD_BITS = 4, 20
#: Bits of the map of frequent bigrams: 2 to this power.
MAP_BITS = 26

#: A-Z to a-z, tabs to spaces, and what ends a piece to a byte that no UTF-8 text has.
_BREAK = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)


def split_words(text: str | None) -> list[bytes]:
    """The words of ``text`` in turn, with _BREAK between its pieces; none for null."""
    return (text or "").encode().translate(_BYTES).replace(_BREAK, b" \xff ").split()


def word_counts(texts: DataFrame, flush: int = FLUSH_WORDS) -> DataFrame:
    """(lang, word, f) of ``texts`` (lang, text)."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                own.pop(_BREAK, None)
                words = list(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array([own[w] for w in words], pa.int64())], ["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(split_words(text.as_py()))
            if sum(map(len, held.values())) > flush:
                yield from rows()
        yield from rows()

    return texts.select("lang", "text").mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def dictionary(counts: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(id, lang, word, f) of the words with ``least`` occurrences or more; ids start at 1 and are nearly dense."""
    group = F.pmod(F.xxhash64("lang", "word"), F.lit(ID_GROUPS))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("lang", "word"))
    return counts.where(F.col("f") >= least).withColumn("g", group).select(((rank - 1) * ID_GROUPS + F.col("g") + 1).cast("int").alias("id"), "lang", "word", "f")


def _trimmed(ids: np.ndarray) -> np.ndarray:
    """``ids`` without words that stand alone and with one 0 between the others."""
    some = ids != 0
    near = np.zeros(len(ids), bool)
    near[1:] |= some[:-1]
    near[:-1] |= some[1:]
    kept = some & near
    last = np.zeros(len(ids), bool)
    last[1:] = ~kept[1:] & kept[:-1]  # the first 0 behind each run
    return np.where(kept, ids, 0)[kept | last]


def encoded(texts: DataFrame, words: DataFrame, sent_words: int = SENT_WORDS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Rows of ids (array<int>, 0 between runs of frequent words) of all ``texts`` (lang, text)."""
    spark = texts.sparkSession
    ship(spark)
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if size[0] > sent_words or size[1] > sent_bytes:
        return encoded_by_join(texts, words)
    known: dict[str, dict[bytes, int]] = {}
    for lang, word, id_ in zip(*(c.to_pylist() for c in words.select("lang", "word", "id").toArrow().columns), strict=True):
        known.setdefault(lang, {})[word.encode()] = id_
    sent = spark.sparkContext.broadcast(known)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: list[int] = []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sent.value.get(lang)
                if own:
                    row += [own.get(w, 0) for w in split_words(text.as_py())]
                    row.append(0)
                if len(row) >= ROW_WORDS:
                    yield _row(row)
                    row = []
        if row:
            yield _row(row)

    return texts.select("lang", "text").mapInArrow(write, "ids array<int>")


def _row(ids: list[int]) -> pa.RecordBatch:
    values = pa.array(_trimmed(np.array(ids, np.int32)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["ids"])


def encoded_by_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The same for a dictionary of any size: words meet it in a shuffled join, and each piece is put together again."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = texts.select("lang", F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]", -1)).alias("piece")).where("piece <> ''").withColumn("n", F.monotonically_increasing_id())
    each = pieces.select("n", "lang", F.posexplode(F.filter(F.split("piece", r"[\x20\x09]+", -1), lambda w: w != "")).alias("k", "word"))
    found = each.join(words.select("lang", "word", "id"), ["lang", "word"], "left").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("id", F.lit(0)).alias("id")))).alias("x"))
    return found.select(F.col("x.id").alias("ids"))


def _slot(first: np.ndarray, second: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """The bit of each pair of ids in the map of frequent bigrams."""
    return (Q.mix((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def ngram_filters(rows: DataFrame, lengths: list[int], bits: int, shard_bits: int, pairs: bytes | None = None) -> DataFrame:
    """(n, shard, filter) of the n-grams of each of ``lengths`` in ``rows`` (ids): what each task has counted, by shard.

    With ``pairs``, the map of frequent bigrams, n-grams with another pair are left out.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(pairs)
    layouts = {n: Q.Layout(n, bits) for n in lengths}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Q.Stack(layout) for n, layout in layouts.items()}
        map_ = None if sent.value is None else np.frombuffer(sent.value, "u1")

        def filters(n: int) -> pa.RecordBatch:
            entries = held[n].take()
            own = Q.shards(entries, layouts[n], min(shard_bits, layouts[n].widths[0]))
            blobs = [Q.encode(entries, at, layouts[n], min(shard_bits, layouts[n].widths[0])) for _, at in own]
            return pa.RecordBatch.from_arrays([pa.array([n] * len(own), pa.int32()), pa.array([s for s, _ in own], pa.int32()), pa.array(blobs, pa.binary())], ["n", "shard", "filter"])

        for batch in batches:
            for row in batch.column(0):
                ids = row.values.to_numpy(zero_copy_only=False)
                for k in range(0, len(ids), ROW_WORDS):  # a piece of any length, with the words that the last n-grams reach into
                    own = ids[k : k + ROW_WORDS + max(lengths) - 1]
                    some = own != 0
                    together = some[:-1] & some[1:]
                    if map_ is not None:
                        slot = _slot(own[:-1], own[1:])
                        together &= (map_[slot >> 3] >> (slot & 7).astype("u1")) & 1 == 1
                    for n in lengths:
                        good = together[: max(0, min(len(own) - n + 1, ROW_WORDS))].copy()
                        for j in range(1, n - 1):
                            good &= together[j : j + len(good)]
                        starts = np.flatnonzero(good)
                        if len(starts):
                            held[n].add(Q.counted([own[starts + j] for j in range(n)], layouts[n]))
                        if len(held[n]) > FLUSH_ENTRIES:
                            yield filters(n)
        for n in lengths:
            yield filters(n)

    return rows.select("ids").mapInArrow(count, "n int, shard int, filter binary")


def merged(filters: DataFrame, bits: int, shard_bits: int, least: int = MIN_COUNT) -> DataFrame:
    """(ids, f, slot) of the n-grams with ``least`` occurrences or more over all ``filters``; slot for bigrams only."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, shard = key[0].as_py(), key[1].as_py()
        layout = Q.Layout(n, bits)
        stack = Q.Stack(layout)
        for batch in batches:
            for blob in batch.column("filter"):
                stack.add(Q.decode(blob.as_py(), shard, layout, min(shard_bits, layout.widths[0])))
        entries = stack.take()
        often = np.flatnonzero(entries.counts >= least)
        ids = layout.unpack(layout.permute([x[often] for x in entries.limbs], back=True))
        slot = pa.array(_slot(ids[0], ids[1]), pa.int64()) if n == 2 else pa.nulls(len(often), pa.int64())
        flat = pa.array(np.stack(ids, axis=1).reshape(-1).astype(np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(often) + 1, dtype=np.int32) * n), flat)
        yield pa.RecordBatch.from_arrays([lists, pa.array(entries.counts[often], pa.int64()), slot], ["ids", "f", "slot"])

    return filters.groupBy("n", "shard").applyInArrow(merge, "ids array<int>, f long, slot long")


def bigram_map(bigrams: DataFrame, bits: int = MAP_BITS) -> bytes:
    """The map of frequent bigrams: a bit for each ``slot`` that one of them has, 2^bits of them whatever the input is."""
    words = bigrams.groupBy((F.col("slot").bitwiseAND(63)).alias("b"), F.shiftright("slot", 6).alias("w")).agg(F.count("*")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out.tobytes()


def frequent_phrases(texts: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, sent_words: int = SENT_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``texts`` (lang, text): (lang, n), n the occurrences of all words; (id, lang, word, f), the frequent words; (ids, f), the frequent phrases of 2 to ``longest`` words."""
    counts = staged(word_counts(texts), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = staged(dictionary(counts, least), "dictionary")
    top, all_ = words.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0], totals.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    bits = int(top).bit_length()
    shard_bits = max(LEAST_SHARD_BITS, min(MOST_SHARD_BITS, (all_ // shard_words).bit_length()))
    rows = staged(encoded(texts, words, sent_words), "ids")
    out = staged(merged(ngram_filters(rows, [2], bits, shard_bits), bits, shard_bits, least), "bigrams")
    if longest > 2:
        more = ngram_filters(rows, list(range(3, longest + 1)), bits, shard_bits, bigram_map(out))
        out = out.unionByName(staged(merged(more, bits, shard_bits, least), "phrases"))
    return totals, words, out.select("ids", "f")


def collocations(texts: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, cover: int = COVER_PERCENT, sent_words: int = SENT_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase with a occurrences, cut into parts with l and r, scores
    floor(1000 a n / (l r)), n the occurrences of all words; its lowest cut
    counts, the shortest first part of equals.  Phrases inside a longer one
    that has ``cover`` percent of their occurrences are dropped.  Ties go by
    occurrences, then by the phrase.  A null text is empty; a null language
    is "und".
    """
    texts = texts.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    totals, words, phrases = frequent_phrases(texts, least, longest, sent_words)
    known = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    size = F.size("ids")
    inner = lambda ids, m: F.transform(F.sequence(F.lit(1), F.size(ids) - m + 1), lambda k: F.slice(ids, k, m))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: inner(F.col("ids"), m)))
    inside = phrases.where(size > 2).select(F.explode(parts).alias("ids"), (F.col("f") * 100).alias("over")).groupBy("ids").agg(F.max("over").alias("over"))
    kept = phrases.join(inside, "ids", "left").where(F.coalesce("over", F.lit(0)) < F.col("f") * cover).select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, size))
    cuts = cuts.join(known.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    langs = words.select(F.col("id").alias("head"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("head", F.element_at("ids", 1)).join(langs, "head")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score: Column = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("ids", "lang", "a", "n", "x.score", "x.l", "x.r")
    # by score and occurrences first, ties kept, so that only what can be reported is spelled out
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    close = staged(best.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= top).drop("rank"), "best")
    spelled = close.select("ids", F.posexplode("ids").alias("k", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("x"))
    named = close.join(spelled, "ids").withColumn("phrase", F.array_join("x.word", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of whole ``documents``; an empty table, or one without frequent phrases, gives no rows."""
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
    FROM split, (SELECT unnest([2, 3, 4]) AS s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT s.* FROM split s LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * s.f),
cuts AS (
  SELECT k.lang, k.phrase, k.f AS a, c AS k, x.f AS l, y.f AS r, n, (1000::HUGEINT * k.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept k JOIN (SELECT unnest([1, 2, 3, 4]) AS c) ON c < k.m JOIN totals USING (lang)
  JOIN counts x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:c], ' ') JOIN counts y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[c + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
