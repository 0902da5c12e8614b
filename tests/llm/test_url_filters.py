"""Rules and parts of urls against plain Python; the template tree on planted branches."""

import re

from pyspark.sql import functions as F

from quillspark.llm import url_filters as u

URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1?x", "https://a.www.Example.COM/en/", "http://com/", "http://com", "http://x.net/es/a#b", "http://net/fr/", "http://xnet/fr/",
        "ftp://a.net/fr?/fr/", "http://exämple.com/é/1", "://", "http:///en/", "http://a.com?b=://c.net/es/", "x://y://net/es/", "http://a.b/" + "s/" * 40, "http://É.NET/es/\nz"]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [(h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_parts_and_rules(spark):
    urls = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(URLS)], "page_id long, url string, rule string")
    marks = spark.createDataFrame([("http://q.org/a/1", 0), (None, 1), ("http://q.org/b", None)], "url string, good int")
    for r in u.judge(urls, marks).collect():
        host, path, (rule, verdict) = by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert u.judge(urls.limit(0), marks.limit(0)).count() == 0


def test_whole_table(spark):
    for r in u.op7_url_filters(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id").collect():
        host, path, (rule, verdict) = by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_tree_tells_branches_apart(spark):
    rows = [(f"http://h.org/spam/{i}", 0) for i in range(30)] + [(f"http://h.org/good/{i}.html", 1) for i in range(200)] + [(f"http://h.org/user{chr(97 + i // 26)}{chr(97 + i % 26)}/about", i % 10 > 0) for i in range(300)]
    marks = spark.createDataFrame([(a, int(b)) for a, b in rows], "url string, good int")
    urls = spark.createDataFrame([(1, "http://h.org/spam/999"), (2, "http://h.org/good/7.html"), (3, "http://h.org/userzz/about"), (4, "http://other.org/spam/9")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.judge(urls, marks).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_branches_merge_by_tests_not_by_counts(spark):
    """Hundreds of siblings: those with few labels share a branch, bad and good ones keep their own, however deep."""
    children = spark.createDataFrame([("h", "", f"s{i:03}", 2, 2 - (i % 10 == 0)) for i in range(400)] + [("h", "", "bad1", 40, 1), ("h", "", "bad2", 50, 2), ("h", "", "half", 200, 100), ("g", "", "only", 5, 0)], "host string, node string, segment string, n long, g long")
    got = {(r.host, r.segment): (r.branch, r.branch_n, r.members) for r in u.merged_branches(children).collect()}
    assert got["h", "s000"][0] == got["h", "s399"][0] == 0 and got["h", "s000"][2] >= 360
    assert got["h", "bad1"] == got["h", "bad2"] == (got["h", "bad1"][0], 90, 2) and got["h", "bad1"][0] > 0
    assert got["h", "half"][1] == 200 and got["g", "only"] == (0, 5, 1)
    deep = "/".join("abcdefghijkl")
    marks = spark.createDataFrame([(f"http://h.org/{deep}/bad/{i}", 0) for i in range(40)] + [(f"http://h.org/{deep}/fine/{i}", 1) for i in range(40)], "url string, good int")
    urls = spark.createDataFrame([(1, f"http://h.org/{deep}/bad/x"), (2, f"http://h.org/{deep}/fine/x"), (3, f"http://h.org/{deep}/bad/5")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in u.judge(urls, marks).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_verdicts_on_held_out_labels(spark):
    """Labels that follow the branch: learned on four fifths, judged on the rest."""
    import random

    rnd = random.Random(8)
    rows = [(f"http://s{h}.org/{b}/{rnd.randrange(10**6)}.html", int(rnd.random() < p)) for h in range(6) for b, p in (("news", 0.95), ("promo", 0.04), ("wiki", 0.9), ("ads", 0.1)) for _ in range(120)]
    rnd.shuffle(rows)
    cut = len(rows) * 4 // 5
    out = u.judge(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows[cut:])], "page_id long, url string, good int"), spark.createDataFrame(rows[:cut], "url string, good int")).collect()
    right = sum((r.verdict == "allow") == (r.good == 1) for r in out)
    print(f"{right} of {len(out)} held-out urls judged as labelled")
    assert right >= 0.9 * len(out)


def test_no_chain_joins_branches_that_differ(spark):
    """Seven siblings, each near its neighbours in rate, beside a large one: the extremes are told from the rest of the chain."""
    rows = [("h", "", f"s{k}", 30, round(30 * rate)) for k, rate in enumerate((0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65))] + [("h", "", "large", 3000, 2700)]
    got = {r.segment: (r.branch_n, r.branch_g) for r in u.merged_branches(spark.createDataFrame(rows, "host string, node string, segment string, n long, g long")).collect()}
    assert got["s0"][1] / got["s0"][0] < 0.2 and got["s6"][1] / got["s6"][0] > 0.5 and got["large"] == (3000, 2700)
    for host, node, segment, n, g in rows[:7]:
        pooled = got[segment][1] / got[segment][0]
        assert abs(g / n - pooled) < 0.3
    marks = spark.createDataFrame([(f"http://h.org/{s}/{i}", int(i < g)) for _, _, s, n, g in rows for i in range(n)], "url string, good int")
    urls = spark.createDataFrame([(1, "http://h.org/s0/x1"), (2, "http://h.org/s6/x1"), (3, "http://h.org/large/x1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in u.judge(urls, marks).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_only_levels_with_a_choice_are_worked_on(spark):
    long = "/".join(f"p{k}" for k in range(400))
    marks = [(f"http://a.org/{long}/x/{i}", 0) for i in range(9)] + [("http://a.org/" + long + "/y/1", 1)] * 9 + [("http://b.org/one", 1)]
    urls = spark.createDataFrame([(1, f"http://a.org/{long}/x/7"), (2, f"http://a.org/{long}/y/7"), (3, "http://a.org/other/x/7"), (4, "http://b.org/two")], "page_id long, url string")
    counts = spark.createDataFrame(marks, "url string, good int").select(u.parts(F.col("url"))[0].alias("host"), u.template(u.parts(F.col("url"))[1]).alias("template"), F.lit(1).alias("labelled"))
    assert u.branching_levels(counts) == [401]
    got = {r.page_id: r.verdict for r in u.judge(urls, spark.createDataFrame(marks, "url string, good int")).collect()}
    assert got[1] == "block" and got[2] == got[4] == "allow"
