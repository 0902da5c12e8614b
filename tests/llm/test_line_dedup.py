"""Line components against all pairs by brute force; what stays of each document."""

import random
from collections import Counter, defaultdict

from quillspark.llm import line_dedup as ld


def norm(line):
    return line.strip(" \t\x0b\x0c\r").lower()


def shingles(line, k=ld.SHINGLE_CHARS):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def links_by_hand(lines, similarity=ld.SIMILARITY):
    """All pairs of similar distinct lines, by way of an inverted index."""
    sets = {x: shingles(x) for x in lines}
    where = defaultdict(list)
    for x, s in sets.items():
        for w in s:
            where[w].append(x)
    out = set()
    for x, s in sets.items():
        both = Counter(y for w in s for y in where[w] if y < x)
        out |= {(y, x) for y, n in both.items() if n / (len(s) + len(sets[y]) - n) >= similarity}
    return out


def groups(lines, links):
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in lines}


def kept_by_hand(docs):
    """Texts that are left of (doc_id, text) rows with different ids."""
    lines = {norm(x) for _, t in docs for x in (t or "").split("\n")} - {""}
    group = groups(lines, links_by_hand(lines))
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        if t is None:
            out[d] = None
            continue
        stay = []
        for x in t.split("\n"):
            g = group.get(norm(x))
            if g is None or g not in seen:
                stay.append(x)
            seen.add(g)
        out[d] = "\n".join(stay)
    return out


def test_small_cases(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until night falls over the town "
    texts = [None, "", base * 3 + "\nshort", "Short\n\n \n" + base * 3, base * 3 + "x", "é" * 30 + "\n" + "é" * 31, "SHORT  \r\nother", "a\nb\na", base * 400, base * 400 + "!", "\n".join([f"line number {i} of many" * 2 for i in range(300)]), base.upper() * 3]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, id int, content string")
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in ld.dedup_lines(df).collect()}
    want = kept_by_hand(docs)
    for d, t in docs:
        assert got[d][0] == want[d], d
        assert got[d][1] == (len(t.split("\n")) if t is not None else 0) and got[d][1] - got[d][2] >= 0
    assert ld.clean_documents(spark, df, "").columns == df.columns
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "same line here\nown line one"), (1, "same line here\nown line one"), (1, "another text of it\nsame line here"), (None, "same line here\nlast words of it")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.kept_text) for r in ld.dedup_lines(df).collect())
    twice = [x for x in got if got.count(x) == 2]
    assert len(got) == 4 and len(twice) == 2 and ("None", "last words of it") in got
    assert sum("same line here" in t for _, t in got) in (1, 2)


def components_of(df):
    """The component of each line that has one, by the line."""
    named = ld.line_components(df, ld.line_marks(df))
    return {r.line: r.component for r in ld.lines_of(df).selectExpr("line", "xxhash64(line) as node").distinct().join(named, "node").collect()}


def test_recall_and_precision_on_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    lines = {norm(x) for _, t in docs for x in t.split("\n")} - {""}
    links = links_by_hand(lines)
    got = components_of(df)
    found = sum(x in got and got[x] == got.get(y) for x, y in links)
    print(f"{found} of {len(links)} links found")
    assert len(links) > 200 and found >= 0.995 * len(links)
    want = groups(lines, links)
    sources = defaultdict(set)
    for x, c in got.items():
        sources[c].add(want[x])
    assert all(len(s) == 1 for s in sources.values())
    left = {r.doc_id: r.kept_text for r in ld.dedup_lines(df).collect()}
    hand = kept_by_hand(docs)
    assert sum(left[d] == hand[d] for d, _ in docs) >= 0.998 * len(docs)


def test_recall_of_one_edit_by_line_length(spark):
    rnd = random.Random(3)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = sorted({norm(x) for r in table.collect() for x in r.text.split("\n")} - {""})
    tried = []
    for size in (30, 50, 120, 260, 500):
        for x in [x for x in base if abs(len(x) - size) <= size // 10][:60]:
            i = rnd.randrange(len(x))
            for y in (x[:-1] + "#", x + "!", x[:i] + ("q" if x[i] != "q" else "z") + x[i + 1 :]):
                a, b = shingles(x), shingles(norm(y))
                if x != norm(y) and len(a & b) / len(a | b) >= ld.SIMILARITY:
                    tried.append((size, x, norm(y)))
    got = components_of(spark.createDataFrame([(i, f"{x}\n{y}") for i, (_, x, y) in enumerate(tried)], "doc_id long, text string"))
    for size in (30, 50, 120, 260, 500):
        own = [x in got and got[x] == got.get(y) for n, x, y in tried if n == size]
        assert len(own) > 90 and sum(own) >= 0.99 * len(own), size


def test_large_families(spark):
    """Hundreds of variants of one line, most of them similar to no other: no link is lost, and few pairs reach the texts."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]
    whole = [rnd.choice(words) for _ in range(70)]
    lines = {" ".join(whole)}
    for _ in range(400):
        own = list(whole)
        for _ in range(rnd.randrange(1, 14)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        lines.add(" ".join(own[: rnd.randrange(60, 71)]))
    docs = [(i, x) for i, x in enumerate(sorted(lines))] + [(1000 + i, " ".join(whole)) for i in range(5)]
    want, got = groups(lines, links_by_hand(lines)), components_of(spark.createDataFrame(docs, "doc_id long, text string"))
    alone = [x for x in lines if x not in got]
    assert len(alone) > 50 and all(sum(want[x] == g for g in want.values()) == 1 for x in alone)
    assert all(len({want[x] for x in got if got[x] == c}) == 1 for c in set(got.values()))


def test_lines_beside_a_center_meet_only_if_similar(spark, monkeypatch):
    """Of a family of variants no pair leaves the join of their differences unless it is similar, or nearly so: the rows follow the links, not the square of the family."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]
    whole = [rnd.choice(words) for _ in range(25)]
    lines = {" ".join(whole)}
    for _ in range(400):
        own = list(whole)
        for _ in range(rnd.randrange(1, 5)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        lines.add(" ".join(own))
    df = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    met, beside = [], ld._alike_beside_centers
    monkeypatch.setattr(ld, "_alike_beside_centers", lambda *a: met.append(beside(*a)) or met[-1])
    got, links = components_of(df), links_by_hand(lines)
    want, named = groups(lines, links), {r.id: r.line for r in ld.lines_of(df).selectExpr("xxhash64(line) as id", "line").collect()}
    pairs = [tuple(sorted((named[r.id_a], named[r.id_b]))) for r in met[0].collect()]
    assert 0 < len(pairs) <= 2 * sum(p in links for p in pairs)
    lost = [p for p in links if got.get(p[0]) is None or got[p[0]] != got.get(p[1])]
    assert not lost and len({want[x] for x in got}) == len(set(got.values()))


def test_bands_are_counted_without_a_table_of_distinct_lines(spark):
    """A line's bands are there once and none is null; a band of one line, however often it occurs, is not shared; of several the most frequent line is the center."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(9, 16))) for _ in range(400)]
    # of few long words, so that neighbours among the word starts are often neighbours among all shingles
    alone = " ".join(rnd.choice(words) for _ in range(24))
    often = " ".join(rnd.choice(words) for _ in range(24))
    near = often + "!"
    texts = [alone] * 5 + [often] * 4 + [near] + ["a", "\tshort line  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = ld.line_marks(df).collect()
    assert all(r.bands and None not in r.bands and len(set(r.bands)) == len(r.bands) for r in marks)
    bands = {r.id: set(r.bands) for r in marks}
    own = {r.line: r.id for r in ld.lines_of(df).selectExpr("line", "xxhash64(line) as id").collect()}
    got = ld._shared_bands(ld.line_marks(df)).collect()
    assert {(r.band, r.id, r.center) for r in got} == {(b, own[x], own[often]) for b in bands[own[often]] & bands[own[near]] for x in (often, near)}
    assert len(got) > 2 and len(got) == len({(r.band, r.id) for r in got})


def test_word_starts(spark):
    lines = ["", "one", "  leading spaces and more", "tabs\tare no starts here", "é" * 40, "one two three four five six seven", "x" * 11, "x" * 12, "a  double  space in the line", "\U0001f600 " * 9]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    size = ld.SIGNED_CHARS
    for r in df.select("line", ld.word_starts(df.line).alias("got")).collect():
        x = r.line
        assert r.got == [x[i : i + size] for i in range(len(x) - size + 1) if x[i] != " " and (i == 0 or x[i - 1] == " ")], x


def interpreted(df):
    """The arguments of higher-order functions in the plan of ``df``: what stands there is not compiled."""
    plan, out = df._jdf.queryExecution().executedPlan().toString(), []
    for name in ("transform(", "filter("):
        at = plan.find(name)
        while at >= 0:
            end, depth = at + len(name), 1
            while depth and end < len(plan):
                depth += {"(": 1, ")": -1}.get(plan[end], 0)
                end += 1
            out.append(plan[at:end])
            at = plan.find(name, at + 1)
    return out


def test_work_on_whole_arrays_is_compiled(spark):
    """Sorting, telling apart and subtracting of hashes stand in projections, not inside lambdas nor in their arguments."""
    df = spark.createDataFrame([(1, "some words\nother words")], "doc_id long, text string")
    lines = spark.createDataFrame([(1, "a" * 9), (2, "a" * 10), (3, "a" * 9 + "b")], "id long, line string")
    met = ld._met(spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long"), lines, ld.SIMILARITY)
    for table in (ld.line_marks(df), met):
        inside = interpreted(table)
        assert inside and not [x for x in inside if any(f in x for f in ("sort_array", "array_distinct", "array_except", "array_intersect"))]
    got = {r.id_b: r for r in met.collect()}
    assert got[2].linked and got[2].differing == 0 and got[2].turns == []
    assert not got[3].linked and got[3].differing == 1 and len(got[3].turns) == 1


def test_blanks_at_the_ends_of_lines(spark):
    blanks = " \t\x0b\x0c\r"
    lines = [a + "Some Words\tin  it" + b for a in ("", *blanks, " \t") for b in ("", *blanks, "\r ")] + [blanks, "", "\x0b", " x "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id: r.line for r in ld.lines_of(df).collect()} == {i: norm(x) for i, x in enumerate(lines) if norm(x)}


def test_lines_are_made_lower_once(spark):
    """Whether a line holds a word is told without its lower case, in both scans of the documents."""
    df = spark.createDataFrame([(1, "Some Words\n \t\nÉTÉ")], "doc_id long, text string")
    lines = ld.lines_of(df)
    assert [(r.pos, r.line) for r in lines.collect()] == [(0, "some words"), (2, "été")]
    for table in (lines, ld.line_marks(df)):
        assert table._jdf.queryExecution().executedPlan().toString().count("lower(") == 1


def test_sizes_of_lines_near_a_center_come_with_the_pairs(spark):
    """A line's size is read with its sketch, not joined once more to its differences."""
    shared = spark.createDataFrame([(7, 1, 1), (7, 2, 1)], "band long, id long, center long")
    texts = ld.with_facts(spark.createDataFrame([(1, "a line of words in it"), (2, "a line of words in it!")], "id long, line string"))
    near = ld._near_centers(shared, texts, ld.SIMILARITY)
    assert [(r.center, r.id, r.n, r.linked) for r in near.collect()] == [(1, 2, 15, True)]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 4
