"""Line de-duplication: one line stays of each group of equal and nearly equal lines.

Lines (case and white space at their ends aside) are known by a 64-bit hash.
A line's MinHash signature is the least hashes of its character shingles; two
neighbours among them make a band, and lines that share a band are candidates.
Sizes and wider signatures sift them, the exact Jaccard similarity decides,
and distributed union-find joins linked lines.  Everything is DataFrame
expressions.

Within a band nobody is compared with everybody.  The most frequent line is
the band's center and meets all others.  Two lines near the center that are
similar to each other, but not both to the center, must differ from it by
mostly the same shingles: they meet by bands of those differences.  Where most
are not similar to the center, what most of them share takes its place.  Only
lines far from their center meet the band's other lines, by classes of size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, staged
from .components import connected_components

SHINGLE_CHARS = 8
SIMILARITY = 0.8
#: Signatures are of longer shingles, which fewer unlike lines share: similarity 0.8 in shingles of 8 is some 0.7 in those of 12.
SIGNED_CHARS = 12
#: A line of at least WORDY words is signed by the shingles at its word starts, one of fewer than WORDS by all shingles; between the two, by both.
WORDY, WORDS = 20, 30
#: A line of fewer word starts than one in SPARSE characters is signed by all shingles, too.
SPARSE = 24
#: A band is two neighbours among a line's least hashes; so many bands of each kind.
BANDS = 8
#: Before texts are compared, so many of their least shingle hashes are.  Their agreement may fall short of what a similarity lets expect by SLACK (3.5 standard deviations at 0.8).
SKETCH, SLACK = 96, 0.11
#: Lines that by their sketches may be so similar to their center are near it, and compared with it exactly.
NEAR = 0.6
#: Groups of so many lines, most of them not similar to their center, are looked at from their core: the shingles that most of up to CORE_LINES of them share.
CROWD, CORE_LINES = 16, 9
#: Of the shingles in which a line differs from its center so many least hashes are kept (all of them, for most lines), and so many serve as bands.
#: Where that is not all of them, the agreement may fall short by TURN_SLACK (2.5 standard deviations at a third).
TURNS, TURN_BANDS, TURN_SLACK = 128, 12, 0.11
#: Candidate lines and removed lines up to this many are broadcast (some ten bytes each); more meet by a shuffle.
BROADCAST_ROWS = 1_000_000


def trimmed(line: Column) -> Column:
    # trimming by a set of characters looks at the whole line, so only lines that need it are trimmed
    blanks = " \t\x0b\x0c\r"
    padded = reduce(Column.__or__, [end(line, F.lit(c)) for c in blanks for end in (F.startswith, F.endswith)])
    return F.when(padded, F.btrim(line, F.lit(blanks))).otherwise(line)


def normalised(line: Column) -> Column:
    return F.lower(trimmed(line))


def shingle_hashes(line: Column, size: int = SHINGLE_CHARS) -> Column:
    """64-bit hashes of all windows of ``size`` characters (UTF-16 units); a shorter line is one window."""
    step = 2 * size

    def windows(b: Column) -> Column:
        last = F.greatest(F.octet_length(b) - step + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda i: F.xxhash64(F.substring(b, i, F.lit(step))))

    return let(F.encode(line, "UTF-16BE"), windows)


def word_starts(line: Column, size: int = SIGNED_CHARS) -> Column:
    """The windows of ``size`` characters that begin a word."""
    # a space before the line makes all starts alike: the pattern can begin with one plain character
    return F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(rf"(?s) (?=([^ ].{{{size - 1}}}))"), F.lit(1))


def signature(least: Column) -> Column:
    """The BANDS + 1 least of sorted hashes, without repeats."""
    few = F.array_distinct(F.slice(least, 1, 4 * (BANDS + 1)))
    enough = (F.size(few) > BANDS) | (F.size(least) <= 4 * (BANDS + 1))
    return F.slice(F.when(enough, few).otherwise(F.array_distinct(least)), 1, BANDS + 1)


def with_signatures(lines: DataFrame) -> DataFrame:
    """``lines`` with their two signatures in place of ``line``: ``some`` by word starts if they are many, ``every`` by all shingles if they are few; null where not used.

    Each step is a projection of its own: what stands inside a lambda, or is an argument of one, is interpreted, value by value in boxes; what stands in columns is compiled.
    """
    keep = [c for c in lines.columns if c != "line"]
    n = F.size("starts")
    some = F.sort_array(F.when(n >= WORDY, F.transform("starts", lambda w: F.xxhash64(w))))
    every = F.sort_array(F.when((n < WORDS) | (n * SPARSE < F.length("line")), shingle_hashes(F.col("line"), SIGNED_CHARS)))
    rows = lines.withColumn("starts", word_starts(F.col("line"))).select(*keep, some.alias("some"), every.alias("every"))
    return rows.select(*keep, signature(F.col("some")).alias("some"), signature(F.col("every")).alias("every"))


def band_keys(signed: Column) -> list[Column]:
    """A key for each two neighbours in a signature (for the one, if it is alone); null for those it has not.

    For two lines of similarity J, two hashes that are neighbours in either
    signature are so in both with a chance of about J squared.
    """
    at = lambda i: F.get(signed, F.lit(i))
    pairs = [F.when(at(i + 1).isNotNull(), F.xxhash64(at(i), at(i + 1))) for i in range(BANDS)]
    return [F.coalesce(pairs[0], at(0)), *pairs[1:]]


def distinct_shingles(line: Column, size: int = SHINGLE_CHARS) -> Column:
    return F.array_distinct(shingle_hashes(line, size))


def narrowed(column: str, body, kind: str) -> Column:
    """``body`` of each of the numbers of an array column.

    The column is named twice, so that Catalyst does not merge the projection that computes it into the lambda's argument.
    """
    return F.when(F.size(column) > 0, F.transform(column, lambda h: body(h).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))


def with_facts(lines: DataFrame) -> DataFrame:
    """``lines`` (id, line) with the number of their shingles and a sketch: 16 bits of each of the SKETCH least hashes."""
    rows = lines.select("id", "line", distinct_shingles(F.col("line")).alias("shingles"))
    rows = rows.select("id", "line", F.size("shingles").alias("n"), F.slice(F.sort_array("shingles"), 1, SKETCH).alias("least"))
    return rows.select("id", "line", "n", F.array_distinct(narrowed("least", lambda h: F.shiftright(F.shiftleft(h, 32), 48), "short")).alias("sketch"))


def could_reach(n: Column, m: Column, one: Column, two: Column, similarity: float, slack: float) -> Column:
    """Whether lines of ``n`` and ``m`` shingles may be so similar: by their sizes (exact), then by how many hashes their sketches share.

    At similarity J lines share J / (1 + J) of their shingles together, and
    their sketches as large a part of the larger line.
    """
    most = F.greatest(n, m)
    expected = similarity / (1 + similarity) * (n + m) / most - slack
    return (F.least(n, m) >= similarity * most) & (F.size(F.array_intersect(one, two)) >= expected * F.least(F.size(one), F.size(two)))


def line_marks(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, content, pos, id, bands) for each line that holds a word; content tells rows with one id apart, id is a hash of the line, and no band is there twice."""
    rows = with_signatures(lines_of(documents, text, key).withColumn("id", F.xxhash64("line")))
    keys = F.array(*band_keys(F.col("some")), *band_keys(F.col("every")))
    return rows.select("doc_id", "content", "pos", "id", F.array_except(keys, F.array(F.lit(None).cast("long"))).alias("bands"))


def lines_of(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, content, pos, line) for each line that holds a word."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "content", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # a condition on the line in lower case would be pushed below it, and each line made lower twice
    return rows.where(trimmed(F.col("line")) != "").withColumn("line", normalised(F.col("line")))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, to be broadcast if its rows (or those it is said to stand for) are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _as(df: DataFrame, end: str, *columns: str) -> DataFrame:
    """``columns`` of ``df``, named for one end of a pair."""
    return df.select(*[F.col(c).alias(f"{c}_{end}") for c in columns])


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (id_a, id_b) with ``columns`` of ``table`` for either end."""
    for end in "ab":
        pairs = pairs.join(_as(table, end, "id", *columns), f"id_{end}")
    return pairs


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose lines are similar enough."""
    # staged, since a condition is pushed below the projections and computes what it needs once more at every place
    met = staged(_met(pairs.select("id_a", "id_b").distinct(), texts, similarity).select("id_a", "id_b", "linked"), "met-pairs")
    return met.where("linked").select("id_a", "id_b")


def _shared_bands(marks: DataFrame) -> DataFrame:
    """(band, id, center) for each band of several lines; the center is the most frequent of them.

    Equal lines have equal bands, so that only the lines in bands of several are counted, and no table of distinct lines is made.
    """
    placed = marks.select(F.explode("bands").alias("band"), "id")
    crowded = staged(placed.groupBy("band").agg(F.min("id").alias("one"), F.max("id").alias("other")).where("one <> other").select("band"), "band-sizes")
    shared = staged(placed.join(_small(crowded), "band").groupBy("band", "id").agg(F.count("*").alias("n")), "bands")
    # a maximum of one number combines before the shuffle; lines that tie in it are settled by the least id
    rank = F.shiftleft(F.least("n", F.lit(2**20 - 1)), 43).bitwiseOR(F.col("id").bitwiseAND(F.lit(2**43 - 1)))
    top = shared.groupBy("band").agg(F.max(rank).alias("rank"))
    center = shared.withColumn("rank", rank).join(top, ["band", "rank"]).groupBy("band").agg(F.min("id").alias("center"))
    return shared.select("band", "id").join(center, "band")


def _differences(rows: DataFrame) -> DataFrame:
    """``rows`` with the Jaccard similarity of their arrays ``x`` and ``y`` (without repeats) in place of these, in how many elements they differ, and the least of those as ``turns``.

    One projection a step, for the same reason as in with_signatures.
    """
    keep = [c for c in rows.columns if c not in ("x", "y")]
    rows = rows.select(*keep, F.size("x").alias("n_x"), F.size("y").alias("n_y"), F.array_except("x", "y").alias("only_x"), F.array_except("y", "x").alias("only_y"))
    jaccard = (F.col("n_x") - F.size("only_x")) / (F.col("n_y") + F.size("only_x"))
    least = F.slice(F.sort_array(F.concat("only_x", "only_y")), 1, TURNS)
    rows = rows.select(*keep, jaccard.alias("jaccard"), (F.size("only_x") + F.size("only_y")).alias("differing"), least.alias("least"))
    return rows.select(*keep, "jaccard", "differing", narrowed("least", lambda h: F.shiftright(h, 32), "int").alias("turns"))


def _met(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` with (linked, differing, turns) of each: whether its lines are similar, in how many and which shingles they differ."""
    rows = _both(pairs, texts, "line").select(*pairs.columns, distinct_shingles(F.col("line_a")).alias("x"), distinct_shingles(F.col("line_b")).alias("y"))
    return _differences(rows).select(*pairs.columns, (F.col("jaccard") >= similarity).alias("linked"), "differing", "turns")


def _near_centers(shared: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(center, id, n, linked, differing, turns) for each line near a center."""
    pairs = shared.where("id <> center").select(F.col("center").alias("id_a"), F.col("id").alias("id_b")).distinct()
    pairs = _both(pairs, texts, "n", "sketch").where(could_reach(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), NEAR, 0))
    near = _met(pairs.select("id_a", "id_b", "n_b"), texts, similarity)
    return near.select(F.col("id_a").alias("center"), F.col("id_b").alias("id"), F.col("n_b").alias("n"), "linked", "differing", "turns")


def _around_cores(near: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The groups of ``near`` most of whose lines are not similar to their center, looked at from their core; and the links found so.

    The core has the shingles that most of a few of the lines share; whatever
    it is, all lines are compared with it, and no link depends on it.  The
    line that differs least from it is the group's new center, and ``linked``
    and the differences are from now on meant for this line and for the core.
    """
    sizes = near.groupBy("center").agg(F.count("*").alias("many"), F.sum(F.col("linked").cast("int")).alias("close"))
    poor = sizes.where(f"many >= {CROWD} and 2 * close < many").select("center")
    lines = staged(near.join(poor, "center").join(texts.select("id", "line"), "id").select("center", "id", "n", distinct_shingles(F.col("line")).alias("shingles")), "odd-groups")
    few = lines.groupBy("center").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(CORE_LINES)])).alias("few"))
    few = few.select("center", F.explode("few").alias("id"), F.size("few").alias("many"))
    common = few.join(lines, ["center", "id"]).select("center", "many", F.explode("shingles").alias("h")).groupBy("center", "h", "many").agg(F.count("*").alias("k")).where("2 * k > many")
    core = common.groupBy("center").agg(F.collect_list("h").alias("core"))  # at most twice as many as a line has
    seen = _differences(lines.join(core, "center").select("center", "id", "n", F.col("shingles").alias("x"), F.col("core").alias("y")))
    seen = staged(seen.drop("jaccard"), "around-cores")
    heads = seen.groupBy("center").agg(F.min(F.struct("differing", "id")).alias("x")).select("center", F.col("x.id").alias("head"))
    seen = seen.join(heads, "center")
    pairs = seen.where("id <> head").select(F.col("head").alias("id_a"), F.col("id").alias("id_b"))
    links = _linked(pairs, texts, similarity).toDF("head", "id")
    out = seen.join(links.withColumn("linked", F.lit(True)), ["head", "id"], "left").select("center", "id", "n", (F.col("linked").isNotNull() | (F.col("id") == F.col("head"))).alias("linked"), "differing", "turns")
    return out, links


def _alike_beside_centers(near: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines near one center that may be similar, though not both to the center.

    With S the shingles in which a line differs from its center, lines a and b
    differ in those in just one of S(a) and S(b).  For disjoint ones that is
    too many unless both lines are similar to the center.  So one of the two
    is not, S(a) and S(b) share what their sizes tell, and some of their least
    hashes are the same.  (The same holds for a core and the line that differs
    least from it.)  Two lines with the same nearest center meet there only.

    Where S(a) and S(b) are kept whole, how many they share tells the
    similarity, so that a pair leaves the join only if its lines are similar;
    one hash may be lost to two that agree in 32 bits.
    """
    odd = near.where("not linked").select("center").distinct()
    turns = near.join(odd, "center", "left_semi").withColumn("turn", F.explode(F.slice("turns", 1, TURN_BANDS)))
    one, two = (_as(turns, end, "center", "turn", "id", "n", "linked", "differing", "turns", "nearest") for end in "ab")
    most = (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b"))
    both = F.greatest((F.col("differing_a") + F.col("differing_b") - most) / 2, F.lit(0))
    expected = both / (F.col("differing_a") + F.col("differing_b") - both) - TURN_SLACK
    shared = F.array_intersect("turns_a", "turns_b")
    whole = F.greatest("differing_a", "differing_b") <= TURNS
    enough = F.when(whole, both - 1).otherwise(expected * F.least(F.size("turns_a"), F.size("turns_b")))
    # a pair meets at each hash it shares, and counts at the least of them
    may = (F.abs(F.col("differing_a") - F.col("differing_b")) <= most) & (F.size(shared) >= enough) & (F.array_min(shared) == F.col("turn_a"))
    meet = (F.col("center_a") == F.col("center_b")) & (F.col("turn_a") == F.col("turn_b")) & ((F.col("nearest_a") != F.col("nearest_b")) | (F.col("nearest_a") == F.col("center_a")))
    return one.where("not linked_a").join(two, meet & (F.col("linked_b") | (F.col("id_a") < F.col("id_b"))) & may).select("id_a", "id_b").distinct()


def _alike_far_from_centers(shared: DataFrame, near: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines in one band that may be similar, one of which is far from the band's center; lines with the same nearest center have met there."""
    nearest = near.select("id", "nearest").distinct()
    met = shared.join(near.select("center", "id", "linked"), ["center", "id"], "left").withColumn("far", F.col("linked").isNull() & (F.col("id") != F.col("center")))
    some = met.groupBy("band").agg(F.max("far").alias("any"), F.count("*").alias("many")).where("any and many > 2").select("band")
    size_class = F.floor(F.log(F.col("n")) / -F.log(F.lit(similarity)))
    met = met.join(some, "band", "left_semi").join(nearest, "id", "left").join(texts.select("id", "n", "sketch"), "id").withColumn("nearest", F.coalesce("nearest", "id")).withColumn("class", size_class)
    one, two = (_as(met, end, "band", "id", "center", "far", "nearest", "n", "sketch", "class") for end in "ab")
    two = two.where("id_b <> center_b").withColumn("class_b", F.explode(F.array(F.col("class_b") - 1, F.col("class_b"), F.col("class_b") + 1)))
    meet = (F.col("band_a") == F.col("band_b")) & (F.col("class_a") == F.col("class_b")) & (F.col("nearest_a") != F.col("nearest_b"))
    may = could_reach(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"), similarity, SLACK)
    return one.where("far_a").join(two, meet & (~F.col("far_b") | (F.col("id_a") < F.col("id_b"))) & may).select("id_a", "id_b").distinct()


def line_components(documents: DataFrame, marks: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(node, component) for each distinct line, known by its id, that is linked to another; ``marks`` are those of ``documents``."""
    shared = staged(_shared_bands(marks), "shared-bands")
    wanted = staged(shared.select("id").distinct(), "candidate-ids")
    lines = lines_of(documents, text, key).select(F.xxhash64("line").alias("id"), "line").join(_small(wanted), "id", "left_semi")
    texts = staged(with_facts(lines.groupBy("id", "line").agg(F.lit(1))), "candidates")
    near = staged(_near_centers(shared, texts, similarity), "near-centers")
    odd, core_links = _around_cores(near, texts, similarity)
    odd = staged(odd, "odd-lines")
    groups = near.join(odd.select("center").distinct(), "center", "left_anti").unionByName(odd)
    nearest = groups.groupBy("id").agg(F.min(F.struct("differing", "center")).alias("x")).select("id", F.col("x.center").alias("nearest"))
    groups = staged(groups.join(nearest, "id"), "groups")
    rest, far = _alike_beside_centers(groups, similarity), _alike_far_from_centers(shared, groups, texts, similarity)
    more = _linked(staged(rest.unionByName(far).distinct(), "sifted-pairs"), texts, similarity)
    links = near.where("linked").select(F.col("center").alias("a"), F.col("id").alias("b"))
    return connected_components(links.unionByName(core_links.toDF("a", "b")).unionByName(more.toDF("a", "b")))


def removed_lines(documents: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, content, positions): the lines of each document that go, as an array of positions from 0.

    Of each component the line with the least (doc_id, content, position)
    stays, ids before null; all its other copies go.
    """
    marks = staged(line_marks(documents, text, key), "line-marks")
    named = staged(line_components(documents, marks, similarity, text, key), "line-components")
    lines = marks.select("doc_id", "content", "pos", "id").join(_small(named.withColumnRenamed("node", "id")), "id", "left")
    lines = lines.select("doc_id", "content", "pos", F.coalesce("component", "id").alias("group"))
    many = lines.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    lines = staged(lines.join(many, "group", "left_semi"), "repeated-lines")
    first = lines.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "pos")).alias("first"))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.content") == F.col("content")) & (F.col("first.pos") == F.col("pos"))
    gone = lines.join(first, "group").where(~stays)
    return gone.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(documents: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", kept: str = "kept_text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``documents`` with the text that is left, the number of its lines, and how many of them were removed.

    Lines without words stay.  Null texts stay null, with no lines.  Rows that
    agree in id and text are one document to this operator, and are treated
    alike; all other columns stay.
    """
    gone = staged(removed_lines(documents, similarity, text, key).select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"), "positions"), "removed-lines")
    gone = _small(gone, gone.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0])
    out = documents.withColumn("__content", F.xxhash64(text))
    out = out.join(gone, F.col(key).cast("long").eqNullSafe(F.col("__d")) & (F.col("__content") == F.col("__c")), "left")
    split = F.split(F.col(text), "\n", -1)
    left = F.filter(split, lambda x, i: ~F.array_contains(F.col("positions"), i))
    return out.withColumns({
        kept: F.when(F.col("positions").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")),
        n_lines: F.coalesce(F.size(split), F.lit(0)).cast("long") * F.col(text).isNotNull().cast("long"),
        n_removed: F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long"),
    }).drop("__d", "__c", "__content", "positions")


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document of ``docs`` without its removed lines; n_chars follows where there is one."""
    out = dedup_lines(docs, kept="__kept", n_lines="__n", n_removed="__r").withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, n_lines, n_removed, and the SHA-256 of the text that is left (null: of the empty text).

    Of rows with equal ids the content decides which lines are whose; an empty table gives no rows.
    """
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
