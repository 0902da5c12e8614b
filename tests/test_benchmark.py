"""Fixtures through the backends on six documents: the floors of each kind of query, failures, latency."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import benchmark
from quillspark.plans.index import Index
from quillspark.sources.fixtures import read_fixture

DOCS = {
    "garden-planning.md": "# Garden planning\n\nRaised beds warm early in spring. Rotate legumes and brassicas each year. Composting returns nitrogen to tired soil, and mulch keeps the water in.",
    "bread-baking.md": "# Bread baking\n\nA sourdough starter needs flour, water and patience. Proofing overnight in the cold gives flavour; steam in the oven gives the crust its shine.",
    "bicycle-repair.md": "# Bicycle repair\n\nA chain that skips is worn: measure the stretch. Truing a wheel means turning spoke nipples by quarters. Brake pads wear with rain and grit.",
    "night-sky.md": "# The night sky\n\nThe ecliptic is the sun's path. Planets wander along it, and meteor showers return each August. A dark place matters more than a large telescope.",
    "river-ecology.md": "# River ecology\n\nMayfly nymphs show that water is clean. Riparian shade keeps trout alive in hot summers, and dams stop the gravel that salmon spawn in.",
    "choir-practice.md": "# Choir practice\n\nWarm up with sirens and lip trills. Altos carry the harmony in the second motet. Breathe low, and watch the conductor at every fermata.",
}
EASY = [("sourdough starter", "bread-baking"), ("spoke nipples", "bicycle-repair"), ("meteor showers", "night-sky"), ("mayfly nymphs", "river-ecology"), ("lip trills", "choir-practice"), ("composting nitrogen", "garden-planning")]
MEDIUM = [("bread crust", "bread-baking"), ("wheel truing", "bicycle-repair"), ("where planets wander", "night-sky"), ("keeping trout alive", "river-ecology"), ("singing harmony", "choir-practice"), ("crop rotation", "garden-planning")]
HARD = [("shiny loaf", "bread-baking"), ("slipping gears", "bicycle-repair"), ("large telescope", "night-sky"), ("spawn gravel", "river-ecology"), ("low breath", "choir-practice"), ("tired soil", "garden-planning")]
FUSION = [("oven steam flavour", "bread-baking"), ("worn chain stretch", "bicycle-repair"), ("dark place sky", "night-sky"), ("river water clean", "river-ecology"), ("conductor fermata", "choir-practice"), ("raised beds mulch", "garden-planning")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bench")
    index = Index(spark, str(root / "index"))
    index.upsert(spark.createDataFrame([("guides", k, v.split("\n")[0][2:], v, "1") for k, v in DOCS.items()], "collection string, path string, title string, body string, modified_at string"))
    index.sync_collections([("guides", str(root), "**/*.md", [], True)])
    queries = [{"id": f"{kind}-{i}", "query": q, "type": kind, "description": "", "expected_files": [f"{want}.md"], "expected_in_top_k": 5 if kind == "hard" else 3} for kind, own in (("easy", EASY), ("medium", MEDIUM), ("hard", HARD), ("fusion", FUSION)) for i, (q, want) in enumerate(own)]
    queries.append({"id": "document", "query": "lex: mayfly\nlex: trout\nvec: clean water", "type": "document", "description": "", "expected_files": ["river-ecology.md", "night-sky.md"], "expected_in_top_k": 2})
    (root / "fixture.json").write_text(json.dumps({"description": "d", "version": 1, "collection": "guides", "queries": queries}, indent=1))
    return index, str(root / "fixture.json"), root


def test_floors_of_lexical_and_hybrid_search(built, spark):
    index, path, _ = built
    index.embed()
    rows = benchmark.run(index, read_fixture(spark, path), ("bm25", "hybrid")).cache()
    assert rows.count() == 50 and rows.where("error is not null").isEmpty() and rows.where("latency_ms <= 0").isEmpty()
    rate = {(r.backend, r.type): (r.h3, r.h5) for r in rows.groupBy("backend", "type").agg(F.avg((F.col("recall_at_3") > 0).cast("int")).alias("h3"), F.avg((F.col("recall_at_5") > 0).cast("int")).alias("h5")).collect()}
    assert rate["bm25", "easy"][0] >= 0.8 and rate["bm25", "medium"][0] >= 0.15 and rate["bm25", "hard"][1] >= 0.15
    assert sum(rate["bm25", k][0] for k in ("easy", "medium", "hard", "fusion")) / 4 >= 0.4
    assert rate["hybrid", "easy"][0] >= 0.8 and rate["hybrid", "medium"][0] >= 0.5 and rate["hybrid", "hard"][1] >= 0.35 and rate["hybrid", "fusion"][0] >= 0.5
    document = {r.backend: r for r in rows.where("type = 'document'").collect()}
    assert document["bm25"].top_files == ["quill://guides/river-ecology.md"] and document["bm25"].total_expected == 2 and document["bm25"].unmatched == "night-sky.md" and document["bm25"].mrr == 1.0
    totals = {r.backend: r for r in benchmark.report(rows).collect()}
    assert totals["bm25"].queries == 25 and totals["bm25"].errors == 0 and totals["bm25"].avg_latency_ms > 0


def test_a_backend_that_fails_has_rows(built, spark, monkeypatch):
    index, path, _ = built

    def broken(*args, **kw):
        raise RuntimeError("no model\nwith details")

    monkeypatch.setattr(Index, "search_vectors", broken)
    rows = {r.id: r for r in benchmark.run(index, read_fixture(spark, path).where("type in ('easy', 'document')"), ("vector", "bm25")).where("backend = 'vector'").collect()}
    assert len(rows) == 7 and all(r.error == "no model" and r.recall == r.mrr == r.f1 == 0 and r.top_files == [] for r in rows.values()) and rows["document"].unmatched == "night-sky.md,river-ecology.md"


def test_fixtures_must_be_whole(built, spark):
    _, path, root = built
    assert read_fixture(spark, path).count() == 25
    one = {"id": "a", "query": "q", "type": "t", "description": "", "expected_files": ["f"], "expected_in_top_k": 1}
    for bad, message in (([one, one], "two queries named a"), ([{k: v for k, v in one.items() if k != "expected_files"}], "not whole")):
        (root / "bad.json").write_text(json.dumps({"description": "", "version": 1, "queries": bad}))
        with pytest.raises(ValueError, match=message):
            read_fixture(spark, str(root / "bad.json"))
