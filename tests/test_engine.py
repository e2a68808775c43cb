"""Pages to graph, on inputs whose results are known; and invariants of the layout."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import graph, layout, notes, views
from glossa.plans import build, catalog
from glossa.sources import pages as sources
from glossa.sources import work
from glossa.streaming import incremental

BASE = "https://www.vatican.va/content/leo-xiv/en/encyclicals/documents/20260515-test-lumen.html"
DEUS = "https://www.vatican.va/content/benedict-xvi/en/encyclicals/documents/hf_ben-xvi_enc_20051225_deus-caritas-est.html"
PAGE = (
    f'<html><head><link rel="canonical" href="{BASE}"><title>Encyclical Letter Test Lumen (15 May 2026)</title></head><body><p>As in John 1:5.</p>'
    f'<p><a name="_ftn1" href="#_ftnref1">[1]</a>&nbsp;Benedict XVI, Encyclical Letter <a href="{DEUS}"><i>Deus Caritas Est</i></a>, 1.</p>'
    '<p><a name="_ftn2" href="#_ftnref2">[2]</a>&nbsp;Ibid., 3.</p><p><a name="_ftn3" href="#_ftnref3">[3]</a>&nbsp;Cf. Saint Augustine, <i>De Trinitate</i>, XV.</p></body></html>'
)
TERSE = '<html><head><title>Lumen</title><meta name="description" content="ENCYCLICAL LETTER LUMEN OF X"></head><body><p>x</p></body></html>'
DOCS = "doc_ord int, is_source boolean, url string, html string"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(0, True, BASE, PAGE), (1, False, DEUS, TERSE), (2, False, "https://h/none.html", None)]
    return build.parse(spark.createDataFrame(rows, DOCS))


def test_documents(parsed):
    rows = {r["doc_ord"]: r for r in parsed["documents"].collect()}
    a = rows[0]
    assert (a["title"], a["author"], a["doc_type"], a["date"], a["doc_key"], a["footnote_count"]) == ("Test Lumen", "Leo XIV", "Encyclical", "15 May 2026", "doc:20260515-test-lumen", 3)
    assert (rows[1]["doc_type"], rows[1]["author"]) == ("Encyclical", "Benedict XVI")
    assert rows[2]["footnote_count"] == 0


def test_citations_inherit(parsed):
    rows = parsed["citations"].orderBy("cite_seq").collect()
    assert [(r["footnote"], r["title"], r["author_key"]) for r in rows] == [(1, "Deus Caritas Est", "benedict xvi"), (2, "Deus Caritas Est", "benedict xvi"), (3, "De Trinitate", "augustine")]
    assert rows[1]["url"] == DEUS and rows[2]["url"] is None


def test_graph(parsed):
    out = build.build(parsed["documents"], parsed["citations"], parsed["scripture"])
    edges = {(r["source"], r["target"], r["type"]): r["weight"] for r in out["edges"].collect()}
    assert edges["doc:20260515-test-lumen", "doc:hf_ben-xvi_enc_20051225_deus-caritas-est", "cites"] == 2
    meta = out["meta"].first()
    assert (meta["in_corpus"], meta["scripture"], meta["edges"]) == (3, 1, len(edges))
    years = {r["id"]: r["year"] for r in out["nodes"].collect()}
    assert years["doc:20260515-test-lumen"] == 2026
    shots = build.snapshot(parsed)
    assert {r["doc_key"]: r["citation_count"] for r in shots["documents"].collect()}["doc:20260515-test-lumen"] == 3


def test_order_of_partitions_does_not_matter(spark, parsed):
    def edges(n):
        parts = [parsed[k].repartition(n) for k in ("documents", "citations", "scripture")]
        return sorted(map(str, graph.merge_edges(graph.edge_events(*parts)).collect()))

    assert edges(1) == edges(7)


def test_cache_and_sinks(spark, tmp_path, parsed):
    url = "https://h/a.html"
    key = spark.range(1).select(F.substring(F.sha2(F.lit(url), 256), 1, 16)).first()[0]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / f"{key}.html").write_text("<p>x</p>")
    urls = spark.createDataFrame([(0, True, url), (1, True, "https://h/b.html")], "doc_ord int, is_source boolean, url string")
    assert [r["html"] for r in sources.cached_pages(spark, str(tmp_path / "cache"), urls).collect()] == ["<p>x</p>"]
    assert [r["url"] for r in sources.missing_pages(spark, str(tmp_path / "cache"), urls).collect()] == ["https://h/b.html"]
    out = build.build(parsed["documents"], parsed["citations"], parsed["scripture"])
    sources.write_graph({k: v.select([c for c in v.columns if c != "first_seq"]) for k, v in out.items()}, str(tmp_path / "graph"))
    assert sources.read_graph(spark, str(tmp_path / "graph"))["edges"].count() == out["edges"].count()
    assert sources.seed_pages(spark).count() == 16


def test_streaming(spark, tmp_path):
    rows = [(0, True, BASE, PAGE), (1, False, DEUS, TERSE)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], DOCS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    incremental.start(spark, str(tmp_path / "in/*"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(180)
    assert incremental.read(spark, str(tmp_path / "out"))["meta"].first()["in_corpus"] == 2


def test_cross_layout(spark):
    random.seed(5)
    rows = [(f"n{i}", random.gauss(0, 1), random.gauss(0, 1), i) for i in range(200)] + [("centre", 0.0, 0.0, 999)]
    out = layout.cross(spark.createDataFrame(rows, "id string, px double, py double, seq long"), "centre").collect()
    at = {r["id"]: (r["x"], r["y"]) for r in out}
    assert at.pop("centre") == (0.0, 0.0) and len(at) == 200
    assert all(min(abs(x), abs(y)) <= 280.01 and max(abs(x), abs(y)) <= 1000.01 for x, y in at.values())
    assert len({round(math.atan2(y, x), 3) for x, y in at.values()}) > 190


def test_spring_pulls_linked_nodes_together():
    import numpy as np

    a, b = np.array([0, 1, 3, 4]), np.array([1, 2, 4, 5])
    pos = layout.spring(6, a, b, np.ones(4))
    near = np.linalg.norm(pos[0] - pos[1])
    assert near < np.linalg.norm(pos[0] - pos[4])


def test_bracket_threshold(spark):
    make = lambda n: "".join(f"<p>[{i}] Leo XIII.</p>" for i in range(1, n + 1))
    found = notes.collect(spark.createDataFrame([("many", make(25)), ("few", make(5))], "url string, html string"))
    assert {r["url"]: r["count"] for r in found.groupBy("url").count().collect()} == {"many": 25}


def test_search_ties_and_empty(spark):
    nodes = spark.createDataFrame([("a", "Peace", 3, 2), ("b", "Peace", 3, 1), ("c", "On peace", 99, 0), ("d", None, 0, 3)], "id string, label string, degree long, first_seq long")
    assert [r["id"] for r in views.search(nodes, "peace").collect()] == ["b", "a", "c"]
    assert views.search(nodes, "zzz").count() == 0
    assert views.toggle(["a", "b"], "a") == ["b"] and views.toggle(["b"], "a") == ["b", "a"]


def test_first_fit_lanes(spark):
    random.seed(2)
    rows, ends, expected = [], [], {}
    spans = sorted((s, s + random.randint(1, 40), i) for i, s in enumerate(random.choices(range(300), k=60)))
    for s, e, i in spans:
        lane = next((k for k, end in enumerate(ends) if end <= s), len(ends))
        ends[lane:lane + 1] = [e]
        expected[f"n{i}"] = lane
        rows.append((f"n{i}", "life", s, e, False, i))
    bands = spark.createDataFrame(rows, "id string, kind string, cs int, ce int, early boolean, first_seq long")
    assert {r["id"]: r["lane"] for r in views.lanes(bands).collect()} == expected


def test_text_functions_keep_nulls(spark):
    row = spark.createDataFrame([(None,)], "t string").select(X.norm_title(F.col("t")).alias("a"), X.author_key(F.col("t")).alias("b"), X.recase_name(F.col("t")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("", None, None)


def test_commands(spark, tmp_path, capsys):
    from glossa.__main__ import main

    spark.createDataFrame([(0, True, BASE, PAGE)], DOCS).write.parquet(str(tmp_path / "pages"))
    assert main(["build", str(tmp_path / "pages"), str(tmp_path / "graph")], spark) == 0
    assert main(["search", str(tmp_path / "graph"), "deus"], spark) == 0
    assert main(["frontier", str(tmp_path / "pages")], spark) == 0
    (tmp_path / "index.html").write_text('<a href="/holy-father/leone-xiv.html">')
    assert main(["validate", str(tmp_path / "index.html")], spark) == 1
    out = capsys.readouterr().out
    assert "1 in_corpus" in out and "Deus Caritas Est" in out and DEUS in out and "pio-x" in out


def test_force_layout_query_runs_the_whole_simulation(spark, monkeypatch):
    runs, spring = [], layout.spring
    monkeypatch.setattr(layout, "spring", lambda *a: runs.append(a[5]) or spring(*a))
    assert catalog.QUERIES["force_layout"](spark, "/root/testdata/sf0.001").count() > 0
    assert runs == [300]


def test_bad_pages_are_skipped_and_bad_seeds_stop_the_build(spark):
    rows = [(0, True, BASE, PAGE), (1, False, DEUS, None), (2, False, "https://h/x.html", "no markup"), (3, False, "", TERSE)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_ord"]: r["error"] for r in build.bad_pages(docs).collect()} == {1: "no content", 3: "no address"}
    out = build.build_graph(docs, placed=False)
    assert out["meta"].first()["in_corpus"] == 2 and out["skipped"].count() == 2 and "x" not in out["nodes"].columns
    with pytest.raises(ValueError, match="seeds"):
        build.build_graph(docs.withColumn("is_source", F.lit(True)), placed=False)


def test_large_graphs_are_placed_too(spark, tmp_path):
    docs = spark.createDataFrame([(0, True, BASE, PAGE), (1, False, DEUS, TERSE)], DOCS)
    out = build.build_graph(docs, largest=1)
    rows = out["nodes"].collect()
    assert len({(r["x"], r["y"]) for r in rows}) == len(rows) > 4 and all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in rows)
    sources.write_document(out, str(tmp_path / "graph.json"))
    import json

    found = json.loads("".join(p.read_text() for p in (tmp_path / "graph.json").glob("part-*")))
    assert (len(found["nodes"]), len(found["edges"])) == (len(rows), out["edges"].count()) and found["meta"]["in_corpus"] == 2
    assert [n["id"] for n in found["nodes"]] == [r["id"] for r in out["nodes"].orderBy("first_seq").collect()]


def test_a_coarsened_graph_is_placed_as_well_as_by_the_simulation(spark):
    rng = random.Random(4)
    size, group = 400, 20
    pairs = {(min(i, j), max(i, j)) for i in range(size) for j in [i - i % group + rng.randrange(group), i - i % group + rng.randrange(group), rng.randrange(size) if rng.random() < 0.1 else i] if i != j}
    near = [[] for _ in range(size)]
    for a, b in pairs:
        near[a].append(b), near[b].append(a)
    steps = []  # (a, b, links between them) from some nodes to all they reach
    for a in range(0, size, 20):
        seen, edge = {a: 0}, [a]
        while edge:
            edge = [v for u in edge for v in near[u] if v not in seen and (seen.setdefault(v, seen[u] + 1) or True)]
        steps += [(a, b, d) for b, d in seen.items() if d]
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(size)], "id string, first_seq long")
    forces = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs], "a string, b string, w double")

    def stress(rows) -> float:
        at = {r["id"]: (r["px"], r["py"]) for r in rows}
        far = [(math.dist(at[f"n{a}"], at[f"n{b}"]), d) for a, b, d in steps]
        scale = sum(x / d for x, d in far) / sum(x * x / d / d for x, d in far)
        return sum((scale * x - d) ** 2 / d / d for x, d in far) / len(far)

    coarse = layout.place(nodes, forces, "n0", coarse=100).collect()
    assert len(coarse) == size and {(r["px"], r["py"]) for r in coarse if r["id"] == "n0"} == {(0.0, 0.0)}
    assert stress(coarse) <= 1.1 * stress(layout.force_layout(nodes, forces, "n0").collect())
    alone = layout.place(nodes.limit(5), forces.limit(0), coarse=2).collect()
    assert len({(r["px"], r["py"]) for r in alone}) == 5


def test_spread_keeps_neighbours_near(spark):
    random.seed(3)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(200)], "id string")
    forces = spark.createDataFrame([(f"n{min(i, j)}", f"n{max(i, j)}", 1.0) for i in range(200) for j in [i - i % 20 + random.randrange(20)] if i != j] * 2, "a string, b string, w double").distinct()
    at = {r["id"]: (r["px"], r["py"]) for r in layout.spread(nodes, forces, "n0").collect()}
    far = lambda a, b: math.dist(at[a], at[b])
    near = [far(r["a"], r["b"]) for r in forces.collect()]
    chance = [far(f"n{random.randrange(200)}", f"n{random.randrange(200)}") for _ in range(2000)]
    assert at["n0"] == (0.0, 0.0) and sum(near) / len(near) < 0.5 * sum(chance) / len(chance)


def test_snapshots_compare(spark, parsed):
    shot = build.snapshot(parsed)
    assert build.differences(shot, build.snapshot(parsed)).count() == 0
    changed = shot | {"authors": shot["authors"].withColumn("n", F.col("n") + 1)}
    found = build.differences(shot, changed).collect()
    assert {(r["part"], r["change"]) for r in found} == {("authors", "gone"), ("authors", "new")}


def test_the_text_zero_is_a_value(spark):
    rows = spark.createDataFrame([("a", 1, "0"), ("a", 2, "x")], "id string, seq int, title string").withColumns({"type": F.lit("document"), "is_source": F.lit(False), "parsed": F.lit(False), "ord": F.lit(0)})
    rows = rows.withColumns({f: F.lit(None).cast("string") for f in ("label", "author", "author_key", "doc_type", "url", "date", "cite", "book", "testament")})
    found = graph.merge_nodes(rows).first()
    assert found["title"] == "0" and found["ord"] is None


def test_settled_rows_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in found.mkString("\n").split("\n") if "shuffle_" in n}

    before, setting = files(), spark.conf.get(work.CLEANUP)
    rows = work.settle(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(4, "k"), "settled")
    assert spark.conf.get(work.CLEANUP) == setting
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:  # Spark deletes them in the background
        time.sleep(0.1)
    assert not files() - before
    assert {(r["k"], r["count"]) for r in rows.collect()} == {(k, 100) for k in range(10)}


def test_a_long_region_of_old_notes_takes_linear_time():
    many = 100_000
    region = "".join(f'<br>({k}) Author, Work {k % 50}. <a name="x">{k}</a>' for k in range(1, many))
    start = time.perf_counter()
    found = notes.split_notes(region)
    assert len(found) == many - 1 and found[-1] == (many - 1, f"Author, Work {(many - 1) % 50}.  {many - 1} ")
    crammed = "<br>" + " ".join(f"word {k} and ({k % 7}) . more" for k in range(many))
    notes._Region(crammed).candidates()
    assert time.perf_counter() - start < 8


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Session VI, Leo XIII, AAS 23 (1931) 221", "Leo XIII"), ("sess xx. Leo XIII,PL 3", "Leo XIII"), ("AAS 23", "Aas 23"), ("Karl Rahner’s, a", "Karl Rahner"), ("Sess.IV", "Sess.IV")],
)
def test_authors_before_apparatus(spark, text, expected):
    found = spark.range(1).select(X.author_type(F.lit(text))["author"].alias("a")).first()["a"]
    assert found == expected


def test_numerals_are_written_again(spark):
    shown = ["I", "IIII", "IX", "VX", "XL", "MCMXCIX", "MMMM", "MMMMM", "IC", "XVI", "", "A", "i"]
    rows = spark.createDataFrame([(x,) for x in shown], "w string").select("w", X.is_numeral(F.col("w")).alias("ok")).collect()
    assert {r.w for r in rows if r.ok} == {"I", "IX", "XL", "MCMXCIX", "MMMM", "XVI"}


def test_documents_of_other_writers_are_read(spark, tmp_path):
    import json

    assert list(sources._elements('{"a": [1, {"b": [2]}, "x]"],"c":{"d":"}"} , "e":[] }')) == [("a", "1"), ("a", '{"b": [2]}'), ("a", '"x]"'), ("c", '{"d":"}"}')]
    assert list(sources._elements("{}")) == []
    nodes = [{"id": "a", "type": "document", "label": "A, {b}", "year": 1900, "span": {"kind": "life", "start": 1, "end": None, "label": "L"}, "unknown": [1]}, {"id": "b", "type": "author", "degree": 3}]
    edges = [{"source": "a", "target": "b", "type": "cites", "weight": 2}, {"source": "a", "target": "gone", "type": "cites", "weight": 1}]
    (tmp_path / "graph.json").write_text(json.dumps({"meta": {"documents": 1}, "more": [1, 2], "nodes": nodes, "edges": edges}, indent=1))
    found = sources.read_document(spark, str(tmp_path / "graph.json"))
    assert [(r.id, r.label, r.year, r.degree) for r in found["nodes"].orderBy("first_seq").collect()] == [("a", "A, {b}", 1900, None), ("b", None, None, 3)]
    assert [tuple(r)[:4] for r in found["edges"].select("source", "target", "type", "weight").collect()] == [("a", "b", "cites", 2)]
    assert found["meta"].first()["documents"] == 1
