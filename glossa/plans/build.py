"""Whole plans: pages to documents, citations and passages; those to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import dims
from glossa.functions import text as X
from glossa.functions import url as U
from glossa.operators import cite, graph, html, layout, notes, scripture
from glossa.sources.work import settle


def body_of(url: Column) -> Column:
    """The body that issued a page: the first entry of its slug without a date or begun by the file's date; null where there is none."""
    slug, date = U.body_slug(url), U.file_date(url)
    return F.coalesce(*[F.when((slug == s) & (F.lit(not d) | (date >= d)), F.lit(n)) for s, d, n in dims.records(dims.BODIES)])


def documents(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_ord, is_source, source_url, url, doc_key, title, raw_title, author, author_key, doc_type, date) of each page."""
    rows = pages.select("doc_ord", "is_source", F.col("url").alias("source_url")).join(html.meta(tokens, "doc_ord").hint("merge"), "doc_ord", "left")
    rows = rows.withColumn("url", html.canonical_url(F.col("canonical"), F.col("og_url"), F.col("source_url"))).withColumn("raw_title", F.coalesce("raw_title", F.lit("")))
    raw = F.coalesce(body_of(F.col("url")), U.pope_name(U.author_slug(F.col("url"))))
    rows = rows.withColumn("author", X.author_display(raw)).withColumn("author_key", X.author_key(raw))
    return rows.select(
        "doc_ord", "is_source", "source_url", "url", U.doc_key(F.col("url")).alias("doc_key"), X.clean_title(F.col("raw_title"), F.col("author")).alias("title"), "raw_title",
        "author", "author_key", X.document_type(F.col("raw_title"), F.col("description")).alias("doc_type"), X.title_date(F.col("raw_title")).alias("date"),
    )


def parse(pages: DataFrame) -> dict[str, DataFrame]:
    """documents (with footnote_count), citations and scripture of raw pages (doc_ord, is_source, url, html).

    A page is known by its ``doc_ord``, so pages of one address stay apart.
    """
    key = "doc_ord"
    texts = pages.select(key, "html")
    heads = settle(html.tokens(texts, key).where(html.in_head()), "heads")
    docs = settle(documents(pages, heads), "documents")
    paragraphs = settle(html.paragraphs(texts, [key]), "paragraphs")
    found = settle(notes.collect(texts, paragraphs, key), "notes")
    # Tables with a row a page or note are no sides for a broadcast, however few bytes they are as files.
    ident = docs.select(key, "doc_key", "is_source").hint("merge")
    feats = settle(notes.features(found, paragraphs, key), "features").join(pages.select(key, "url").hint("merge"), key)
    feats = settle(cite.note_features(feats, F.col("url")).drop("url"), "note-features")
    cites = cite.canonicalise(cite.fold(feats, key)).join(ident, key)
    refs = scripture.counts(scripture.references(html.texts(texts, key), key), key)
    counts = found.groupBy(key).agg(F.count("*").cast("int").alias("footnote_count")).hint("merge")
    docs = docs.join(counts, key, "left").withColumn("footnote_count", F.coalesce("footnote_count", F.lit(0)))
    return {"documents": docs, "citations": settle(cites, "citations"), "scripture": settle(refs.join(ident, key), "scripture")}


def build(documents_: DataFrame, citations: DataFrame, scripture_: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and meta of parsed documents, citations and passages."""
    cites = graph.canonical_targets(citations, graph.title_index(documents_, citations))
    edges = graph.merge_edges(graph.edge_events(documents_, cites, scripture_))
    nodes = graph.enrich(graph.merge_nodes(graph.node_events(documents_, cites, scripture_)), edges)
    return {"nodes": nodes, "edges": edges, "meta": graph.meta(nodes, edges)}


def bad_pages(pages: DataFrame) -> DataFrame:
    """(doc_ord, is_source, url, error): pages that cannot be parsed into a document."""
    return pages.select("doc_ord", "is_source", "url", _error().alias("error")).where("error is not null")


def _error() -> Column:
    empty = F.trim(F.coalesce("html", F.lit(""))) == ""
    return F.when(F.coalesce("url", F.lit("")) == "", "no address").when(empty, "no content")


def bad() -> Column:
    """Whether a page is one of ``bad_pages``."""
    return _error().isNotNull()


def build_graph(pages: DataFrame, centre: str | None = None, recurse: bool = True, placed: bool = True, largest: int = 2000) -> dict[str, DataFrame]:
    """The graph of raw pages, laid out, and the frontier of pages to bring next. Without ``recurse`` only seeds count.

    A seed that cannot be parsed is an error; other such pages are left out and listed under ``skipped``. Graphs are placed
    by the force simulation over at most ``largest`` nodes, larger ones coarsened for it (``layout.place``); without ``placed`` nodes have no places.
    """
    pages = pages if recurse else pages.where("is_source")
    skipped = settle(bad_pages(pages), "skipped")
    seeds = [f"{r['url']}: {r['error']}" for r in skipped.where("is_source").limit(10).collect()]
    if seeds:
        raise ValueError("seeds that cannot be parsed: " + "; ".join(seeds))
    parsed = parse(pages.join(skipped.select("doc_ord"), "doc_ord", "left_anti"))
    out = build(parsed["documents"], parsed["citations"], parsed["scripture"])
    out = {k: settle(v, k) for k, v in out.items()}
    if placed:
        nodes, forces = out["nodes"].select("id", "first_seq"), graph.force_weights(out["edges"])
        found = layout.place(nodes, settle(forces, "forces"), centre, coarse=largest)
        at = layout.cross(found.select("id", "px", "py", F.col("first_seq").alias("seq")), centre)
        out["nodes"] = out["nodes"].join(at.select("id", "x", "y"), "id")
    out["frontier"] = graph.frontier(parsed["documents"], parsed["citations"])
    out["skipped"] = skipped
    return out


def snapshot(parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a regression run compares for each document: scalars, histograms of authors and passages, and the citations in order."""
    docs, cites, refs = parsed["documents"], parsed["citations"], parsed["scripture"]
    n_cites = cites.groupBy("doc_key").agg(F.count("*").alias("citation_count"))
    n_refs = refs.groupBy("doc_key").agg(F.sum("cnt").alias("scripture_count"))
    scalars = docs.join(n_cites, "doc_key", "left").join(n_refs, "doc_key", "left").na.fill(0, ["citation_count", "scripture_count"])
    authors = cites.groupBy("doc_key", F.coalesce("author_key", F.lit("<none>")).alias("author_key")).agg(F.count("*").alias("n"))
    return {"documents": scalars, "authors": authors, "scripture": refs.select("doc_key", "book", "cite", "cnt"), "citations": cites}


def store_snapshot(shot: dict[str, DataFrame], path: str) -> None:
    for name, df in shot.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A stored snapshot, to be compared with the present one by ``differences``."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "authors", "scripture", "citations")}


def records(parsed: dict[str, DataFrame]) -> DataFrame:
    """One row a document with its ``citations`` in order and its ``scripture`` by first place, nested, as a record of its own."""
    docs, key = parsed["documents"], "doc_ord"

    def nested(name: str, order: str, fields: list[str]) -> DataFrame:
        inner = F.array_sort(F.collect_list(F.struct(order, *fields)))
        return parsed[name].groupBy(key).agg(F.transform(inner, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))

    cites = nested("citations", "cite_seq", ["footnote", "target_key", "title", "url", "author", "author_key", "doc_type"])
    refs = nested("scripture", "ref_seq", ["cite", "book", "testament", "ord", "cnt"])
    out = docs.join(cites, key, "left").join(refs, key, "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in ("citations", "scripture")})


def differences(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """(part, change, row): what two snapshots do not share, as JSON; rows of ``before`` are ``gone``, rows of ``now`` are ``new``."""
    out = None
    for name in sorted(set(before) & set(now)):
        shared = [c for c in before[name].columns if c in now[name].columns]
        old, new = (s[name].select(F.to_json(F.struct(*shared)).alias("row")) for s in (before, now))
        for change, rows in (("gone", old.exceptAll(new)), ("new", new.exceptAll(old))):
            part = rows.select(F.lit(name).alias("part"), F.lit(change).alias("change"), "row")
            out = part if out is None else out.unionByName(part)
    return out
