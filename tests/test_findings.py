"""Odd inputs and larger tables on which queries once failed."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.operators import graph, html, interact, layout, notes, scan
from glossa.plans import catalog, volume  # noqa: F401
from glossa.sources import pages


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).select(*columns).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", ["raw_titles", "page_texts"])
def test_references_without_an_end_or_of_other_names_stay_as_the_sql_has_them(spark, tmp_path, name):
    rows = [(1, "<html><title>Rest &amp</title><p>Cut &lt and &eacute; off &amp;lt;</p></html>"), (2, "<title>a &quot;b&quot; &#233;</title><p>&copy; &copy &#233;</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, name, ["pages"])


def written(spark, make, node_name="Join", name="number of output rows"):
    """What ``make`` returns and how many rows its joins (or what else is named) have put out, by the SQL metrics of the plans that ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = make()
    joins = 0
    for k in range(before, store.executionsCount()):
        run = store.executionsList(k, 1).apply(0)
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for i in range(nodes.size()):
            if node_name in (node := nodes.apply(i)).name():
                for j in range(node.metrics().size()):
                    if (metric := node.metrics().apply(j)).name() == name and values.contains(metric.accumulatorId()):
                        joins += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out, joins


def test_a_click_meets_a_few_of_the_shapes_that_lie_under_it(spark):
    clicks = spark.range(200).selectExpr("id as click", "cast(id % 20 as double) as x", "cast(id % 10 as double) + 0.5 as y")
    nodes = spark.range(3000).selectExpr("concat('n', id) as id", "id as first_seq", "cast(id % 20 as double) as sx", "cast(id % 12 as double) as sy", "1.0 as op", "id % 97 as degree", "false as is_source", "'document' as type")
    found, joins = written(spark, lambda: {r["click"]: (r["id"], r["d"]) for r in interact.nodes_at(nodes, clicks).collect()})
    rows, expected = nodes.collect(), {}
    for c in clicks.collect():
        near = [((r["sx"] - c["x"]) ** 2 + (r["sy"] - c["y"]) ** 2, r["first_seq"], r["id"]) for r in rows]
        expected[c["click"]] = (min(near)[2], min(near)[0])
    assert found == expected
    assert joins < 200 * 100  # all nodes lie in each click's reach: 600,000 pairs
    rects = spark.range(3000).selectExpr("concat('r', id) as id", "cast(0 as double) as x0", "cast(id % 30 as double) as x1", "cast(0 as double) as y0", "cast(id % 15 as double) as y1", "id as seq")
    found, joins = written(spark, lambda: {r["click"]: r["id"] for r in interact.bands_at(rects, clicks).collect()})
    rows = rects.collect()
    expected = {c["click"]: min((r["seq"], r["id"]) for r in rows if r["x0"] - 3 <= c["x"] <= r["x1"] + 3 and r["y0"] <= c["y"] <= r["y1"])[1] for c in clicks.collect()}
    assert found == expected
    assert joins < 200 * 200


def test_the_simulation_runs_over_a_bounded_graph_where_no_forces_are_left(spark, monkeypatch):
    runs, spring = [], layout.spring
    monkeypatch.setattr(layout, "spring", lambda n, *rest: runs.append(n) or spring(n, *rest))
    nodes = spark.range(900).selectExpr("concat('n', id) as id")
    pairs = spark.range(0, 900, 3).selectExpr("concat('n', id) as a", "concat('n', id + 1) as b", "1.0D as w")  # 300 pairs, 300 nodes alone
    at = layout.place(nodes, pairs, coarse=50, rounds=2, iterations=30).collect()
    assert len({(r["px"], r["py"]) for r in at}) == len({r["id"] for r in at}) == 900
    assert max(runs) <= 50


def test_all_links_of_parts_and_suppliers_are_placed_and_judged(spark, tmp_path, monkeypatch):
    lines = [(p, s) for p in range(12) for s in range(4) for _ in range(1 + (p % 4 == s)) if (p + s) % 4 < 3]  # three suppliers a part, for some of them one with two lines
    spark.range(12).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(4).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    given, found = [], []
    for near in (True, False):  # suppliers in a row, each part beside those it has, or beside the one it has not
        at = {f"s{s}": (float(s), 0.0) for s in range(4)} | {f"p{p}": ((-p - 2 if near else -p - 1) % 4 + p / 1000, 1.0) for p in range(12)}
        places = spark.createDataFrame([(2 * int(k[1:]) + (k[0] == "s"), *v) for k, v in at.items()], "id long, px double, py double")
        monkeypatch.setattr(layout, "place", lambda nodes, forces, *rest, places=places, **named: given.append({(r["a"], r["b"]): r["w"] for r in forces.collect()}) or nodes.join(places, "id"))
        rows = catalog.QUERIES["coarse_places"](spark, str(tmp_path)).collect()
        gaps = {(p, s): (at[f"p{p}"][0] - at[f"s{s}"][0]) ** 2 + 1 for p in range(12) for s in range(4)}
        mean = lambda keys: sum(gaps[k] for k in keys) / len(keys)
        expected = mean(set(lines)) < mean(set(gaps) - set(lines))
        assert len(rows) == 16 and {(r["placed"], r["apart"], r["linked_nearer"]) for r in rows} == {(True, True, expected)}
        assert {r["id"] for r in rows} == set(at)
        found.append(expected)
    assert found == [True, False]
    assert given == [{(2 * p, 2 * s + 1): float(lines.count((p, s))) for p, s in set(lines)}] * 2


def test_where_all_or_none_are_linked_nothing_lies_nearer(spark):
    at = spark.createDataFrame([(2, 0.1, 0.7), (4, 0.3, 0.2), (3, 0.9, 0.4)], "id long, px double, py double")
    pairs = spark.createDataFrame([(2, 3), (4, 3), (18, 3)], "a long, b long")  # 18 is no node
    for links in (pairs, pairs.limit(0)):
        assert [r["linked_nearer"] for r in volume.nearer(at, links).collect()] == [True]


def test_forces_are_merged_where_their_events_were_dealt_to(spark):
    events = spark.range(500).selectExpr("concat('n', id % 7) as source", "concat('n', id % 5) as target", "elt(1 + id % 3, 'cites', 'authored_by', 'cites_scripture') as type", "id % 4 + 1 as n", "id as seq")
    merged = graph.event_forces(events)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the plan before it runs
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, graph.force_weights(graph.merge_edges(events)).collect()))


def test_records_are_written_compressed_and_read_again(spark, tmp_path, monkeypatch):
    paths, write = [], volume.pages.write_json
    monkeypatch.setattr(volume.pages, "write_json", lambda df, path, *rest, **named: paths.append(path) or write(df, path, *rest, **named))
    assert volume.document_records(spark, "/root/testdata/sf0.001").count() > 0
    path = paths[0].removeprefix("file:")
    assert all(f.endswith(".json.gz") for f in os.listdir(path) if f.startswith("part-"))


def test_a_document_is_cut_as_it_comes_and_not_held(spark, tmp_path):
    text = '{"meta": {"documents": 12}, "other": 125,\n"nodes": [\n' + ",\n".join(f'{{"id": "n{k}",\n "label": "a ] \\" }} {k}"}}' for k in range(3000)) + '\n], "edges": []}'
    for size in (1, 7, 1000, len(text)):
        found, most, out = pages._Elements(), 0, []
        for at in range(0, len(text), size):
            out += found.take(text[at : at + size])
            most = max(most, len(found.text))
        out += found.take("", last=True)
        assert [n for n, _ in out] == ["meta", "other"] + ["nodes"] * 3000 and out[1][1] == "125" and json.loads(out[-1][1])["id"] == "n2999"
        assert most < 200 or size == len(text)
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "part-0.txt").write_text(text[:5000])
    (tmp_path / "doc" / "part-1.txt").write_text(text[5000:])
    plan = pages.read_document(spark, f"file://{tmp_path}/doc")["nodes"]
    assert plan.count() == 3000


PAGES = [
    ("a", '<html><head><link rel="canonical" href="http://x/c.html"><title>T &amp; U</title></head><body><p>Body.</p><p><a name="_ftn1" href="#_ftnref1">[1]</a> Cf. Writer&nbsp;A, <a href="/x/documents/w1.html"><i>Work</i> 1</a>, <a href="/x/documents/w1.html">again</a> <i>x</p>'),
    ("b", "<p>One<a href='/x/documents/b.html'>two<p>three</a><div>NOTES</div><p> NO TES </p><p>1. Cf. <i>One &lt</i> <a href=/x/documents/c.html>c<!-- no --> d</p><p>2. <b>x</b>"),
    ("c", "<p>Text</p><hr><p>1. One, <i>Opus</i><p>more</p> 2. Two <a href='/x/documents/d.html'>d</a>, 3"), ("d", ""), ("e", "<"),
]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")  # of the plan before it runs


def test_notes_are_made_of_paragraphs_and_no_token_is_shuffled_for_them(spark):
    pages_ = spark.createDataFrame(PAGES, "url string, html string")
    paragraphs = html.paragraphs(pages_, ["url"])
    found = notes.collect(pages_, paragraphs)
    rows = notes.features(found, paragraphs)
    assert {(r["url"], r["number"]): (r["text"], [tuple(x) for x in r["links"]], r["italics"], r["prefix"]) for r in rows.collect()} == {
        ("a", 1): ("[1] Cf. Writer A, Work 1 , again x", [("/x/documents/w1.html", "Work 1")], ["Work", "x"], "[1] Cf. Writer A,"),
        ("b", 1): ("1. Cf. One < c d", [("/x/documents/c.html", "c d")], ["One <"], "1. Cf. One <"), ("b", 2): ("2. x", [], [], None),
        ("c", 1): ("One, Opus more", [], ["Opus"], None), ("c", 2): ("Two d , 3", [("/x/documents/d.html", "d")], [], "Two"),
    }
    known = spark.createDataFrame([], found.select("url", "block", "note_seq", "number", "note_html").schema)
    assert exchanges(notes.features(known, paragraphs)) <= 2


def test_links_of_pages_are_those_of_their_tokens_without_a_shuffle(spark):
    pages_ = spark.createDataFrame(PAGES, "url string, html string")
    whole = html.links(html.tokens(pages_))
    found = html.page_links(pages_)
    assert sorted(map(tuple, found.select(whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert exchanges(found) == 0
    assert sorted(map(tuple, html.texts(pages_).collect())) == sorted(map(tuple, html.page_text(html.tokens(pages_)).collect()))


def test_what_enters_a_block_of_notes_is_not_broadcast(spark):
    rows = spark.range(300).selectExpr("id % 30 as d", "id as k", "id % 4 = 0 as reset", "if(id % 3 = 0, concat('v', id), null) as v")
    found = scan.running(rows, ["d"], "k", {"s": (F.col("reset"), F.col("v"))}, size=50)
    assert found.count() == len(found.collect()) == 300
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_of_events_behind_a_parse_that_lacks_fields_only_those_that_may_count_are_shuffled(spark):
    n, fields = 12000, [*graph.FIELDS, *graph.BOOK]
    events = spark.range(n).selectExpr(
        "concat('n', id * 7919 % 61) as id", "if(id % 61 = 60, 'author', 'document') as type", "id as seq", "id % 1999 = 5 as parsed", "id % 1013 = 7 as is_source",
        *[f"if(id * {2 * k + 3} % {k + 4} = 1, elt(cast(1 + id % 2 as int), '', null), concat('{f}', id)) as {f}" for k, f in enumerate(fields) if f != "ord"], "cast(id % 3 as int) as ord",
    )
    found, shuffled = written(spark, lambda: {r["id"]: r for r in graph.merge_nodes(events).collect()}, "Exchange", "shuffle records written")
    by_id = {}
    for r in events.orderBy("seq").collect():
        by_id.setdefault(r["id"], []).append(r)
    assert set(found) == set(by_id) and any(r["in_corpus"] for r in found.values()) and not all(r["in_corpus"] for r in found.values())
    for id_, rows in by_id.items():
        parses, told = [r for r in rows if r["parsed"]], [r for r in rows if not r["parsed"]]
        first = lambda f, of: next((r[f] for r in of if r[f]), None)
        now, r = parses[-1:], found[id_]
        for f in graph.FIELDS:
            assert r[f] == (first(f, [*now, *[t for t in told if t["seq"] > now[0]["seq"]]]) if now else first(f, told)), (id_, f)
        for f in graph.BOOK:
            assert r[f] == first(f, [*now, *told] if now and parses[0]["seq"] < told[0]["seq"] else [*told, *now]), (id_, f)
        assert (r["type"], r["first_seq"], r["is_source"]) == (rows[0]["type"], rows[0]["seq"], any(x["is_source"] for x in rows))
    assert shuffled < n
    few = ["title", "url"]
    assert sorted(map(tuple, graph.merge_nodes(events, few).select("id", *few, "first_seq").collect())) == sorted((k, r["title"], r["url"], r["first_seq"]) for k, r in found.items())


def test_a_map_of_keys_loses_no_row_that_has_one(spark):
    rows, side = spark.range(5000).selectExpr("concat('k', id) as k", "id as seq"), spark.range(0, 5000, 50).selectExpr("concat('k', id) as k", "id as at")
    kept = {r["seq"] for r in graph.may_meet(rows, (side, ["k"])).collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 200
    kept = {r["seq"] for r in graph.may_meet(rows, (side, ["k"]), (rows.where("seq < 7"), ["k", "seq"])).collect()}
    assert kept >= {*range(7), *range(0, 5000, 50)} and len(kept) < 200
    assert graph.may_meet(rows, (side.where("false"), ["k"])).count() == 0
