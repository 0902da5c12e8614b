"""Archives round trip, revisits, and the merged order of the index."""

import random

from quillspark.llm import merging, warc

LONG = "<p>é" + "x" * 200


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a.com/x?q=1#f", LONG), (1, "https://www.b.org/", LONG), (2, None, LONG), (None, "nothing", LONG), (4, "http://u@a.com:80/Y\r\nEvil: 1", "short"), (5, "http://a.com", "short"),
            (6, "http://a.com/", None), (7, "http://a.com/", ""), (8, "http://a.com/x", "WARC/1.1\r\n\r\n\r\n\r\n"), (1, "https://www.b.org/", LONG), (9, "http://c/", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w", records_per_file=2)
    got = warc.merge_index(warc.read_archives(spark, f"{tmp_path}/w"), range_records=3, run_records=2).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "response" and by[1].refers_to is None
    assert all(by[k].record_type == "revisit" and by[k].refers_to == 1 for k in (2, 3, None))
    assert by[4].record_type == by[5].record_type == by[7].record_type == "response" and by[6].payload_bytes == 0
    assert by[9].payload_bytes == 3_000_000 and by[3].payload_bytes == len(LONG.encode())
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order == sorted(order) and len({r.part for r in got}) > 1


def test_sql(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet' union all select page_id + 1000, url, html from '{sf}/pages.parquet'")
    want = sorted(con.sql(warc.OP2_SQL).fetchall())
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    both = pages.unionByName(pages.withColumn("page_id", pages.page_id + 1000))
    path = warc.scratch_path(spark, "test")
    warc.write_archives(both, path)
    out = warc.merge_index(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, out.collect())) == want and any(r[3] == "revisit" for r in want)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, f"{tmp_path}/e")
    assert warc.merge_index(warc.read_archives(spark, f"{tmp_path}/e")).count() == 0


def test_loser_trees():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choice([b"a", b"ab", b""]) * rng.randrange(6) + bytes([rng.randrange(97, 100)]) * rng.randrange(40) for _ in range(rng.randrange(12))) for _ in range(k)]
        want = sorted(x for r in runs for x in r)
        assert [runs[a][b] for a, b in merging.merge(runs)] == want
        coded = [merging.front_code(r) for r in runs]
        assert [merging.front_decode(*c) for c in coded] == runs
        last = b""
        for (a, b, n), x in zip(merging.merge_prefixes([(r, c[0]) for r, c in zip(runs, coded, strict=True)]), want, strict=True):
            assert runs[a][b] == x and n == merging.common_prefix(last, x)
            last = x


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com:80/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("http://example.com") == "com,example)/" and warc.url_key("Mailto:X") == "mailto:x" and warc.url_key(None) == ""
