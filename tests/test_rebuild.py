"""A store brought up to date gives what a whole build gives."""

from pyspark.sql import functions as F

from glossa.operators import graph
from glossa.plans import build, rebuild

HOST = "https://www.vatican.va/content/leo-xiv/en/letters/documents/"


def page(k, notes, title=None):
    body = "".join(f'<p><a name="_ftn{i}" href="#_ftnref{i}">[{i}]</a> {n}</p>' for i, n in enumerate(notes, 1))
    return (k, k == 0, f"{HOST}p{k}.html", f"<html><head><title>{title or f'Page {k}'}</title></head><body><p>As in John 1:{k + 1}.</p>{body}</body></html>")


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_only_changed_pages_are_parsed_and_the_graph_is_that_of_a_whole_build(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "doc_ord int, is_source boolean, url string, html string"
    make = lambda pages: spark.createDataFrame(pages, schema)
    first = [page(0, ["Ada Writer, <i>Rerum</i>, 1.", "Ibid., 2."]), page(1, ["Bo Other, <i>Page 2</i>."]), page(2, ["Cy Third, <i>Opus</i>."]), (9, False, "https://h/bad", "")]
    assert rebuild.update(spark, store, make(first)) == {"version": 0, "parsed": 3, "gone": 0, "kept": 0}
    assert rebuild.update(spark, store, make(first)) == {"version": 0, "parsed": 0, "gone": 0, "kept": 3}
    # Page 0 changes, page 2 goes and with it the node that page 1's citation was settled on, page 3 comes.
    then = [page(0, ["Ada Writer, <i>Rerum</i>, 1.", "Ibid., 2.", "Ibid., 3."]), first[1], page(3, ["Idem."])]
    # What a broken-off update has written is not read.
    spark.read.parquet(f"{store}/documents/version=0").write.parquet(f"{store}/documents/version=7")
    assert rebuild.update(spark, store, make(then)) == {"version": 1, "parsed": 2, "gone": 1, "kept": 1}
    whole = build.parse(make(then))
    expected = build.build(whole["documents"], whole["citations"], whole["scripture"])
    found = {name: df for name, df in rebuild.tables(spark, store).items()}
    assert rows(found["citations"], "doc_key", "cite_seq", "target_key", "title") == rows(whole["citations"], "doc_key", "cite_seq", "target_key", "title")
    assert rows(rebuild.edges(spark, store), "source", "target", "type", "weight") == rows(expected["edges"], "source", "target", "type", "weight")
    assert rows(rebuild.graph_of(spark, store)["nodes"], "id", "title", "degree", "in_corpus") == rows(expected["nodes"], "id", "title", "degree", "in_corpus")


def test_hubs_and_missing_keys_join_as_others_do(spark):
    rows_ = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hub").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    side = spark.createDataFrame([("hub", 1), ("k1", 2), ("k8", 3), ("unused", 4)], "k string, v int")
    key = lambda r: (r["id"], r["k"], r["v"])
    assert sorted(map(key, graph.hub_join(rows_, side, "k", ["id"]).collect())) == sorted(map(key, rows_.join(side, "k", "left").collect()))
