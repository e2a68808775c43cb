"""The citation graph from an event log: one row per touch of a node or edge, with its place in reading order.

Merging is aggregation over that log, so any number of documents and of events per node runs in parallel: places in reading order are one whole number each,
and sums and first-by-order minima combine map-side. Where rows meet a table by a key that
many of them may share - a node's last parse, a title's node - they do so by ``hub_join``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import dims
from glossa.functions import text as X
from glossa.functions import url as U
from glossa.sources.work import settle

FIELDS = ["label", "title", "author", "author_key", "doc_type", "url", "date"]
BOOK = ["cite", "book", "testament", "ord"]


NUMERIC = {"ord"}


def given(name: str) -> Column:
    """Missing values, empty texts and zero numbers count as not given; the text "0" is one."""
    return F.col(name).isNotNull() & (F.col(name) != F.lit(0) if name.rpartition(".")[2] in NUMERIC else F.col(name) != "")


def title_index(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """(norm_title, target): of documents the last with the title, else of citations with a URL the first; seeds are read before other documents."""
    phase = F.when(F.col("is_source"), 0).otherwise(1)
    own = documents.groupBy(X.norm_title(F.col("title")).alias("norm_title")).agg(F.max_by("doc_key", F.struct(phase, "doc_ord")).alias("own"))
    cited = citations.where(F.coalesce("url", F.lit("")) != "").groupBy(X.norm_title(F.col("title")).alias("norm_title")).agg(F.min_by("target_key", F.struct(phase, "doc_ord", "cite_seq")).alias("cited"))
    return own.join(cited, "norm_title", "full").select("norm_title", F.coalesce("own", "cited").alias("target"))


#: The share of rows in which hubs are looked for.
HUB_SAMPLE = 0.05


def hub_join(rows: DataFrame, side: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined to ``side``, which holds a key once, such that no key's rows meet in one task.

    A key is a hub if it has more than one in twice the number of shuffle partitions of the rows of a sample; so there are at most twice as many hubs as
    partitions and their rows of ``side`` are broadcast. Rows of hubs, and rows without a key, go through the shuffle by a hash of ``spread`` and find nothing there.
    The sample decides which way a row takes and not what it finds.
    """
    most = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).select(key).sample(HUB_SAMPLE, seed=1).groupBy(key).agg(F.count("*").alias("_n"))
    hubs = counts.crossJoin(counts.agg(F.sum("_n").alias("_all"))).where(F.col("_n") * most > F.col("_all")).select(key)  # by one row
    hot = side.join(F.broadcast(hubs), key, "left_semi").select(key, F.struct(*[c for c in side.columns if c != key]).alias("_hot"))
    out = rows.join(F.broadcast(hubs.withColumn("_hub", F.lit(True))), key, "left").join(F.broadcast(hot), key, "left")
    alone = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("string"))
    out = out.withColumn("_key", F.when(F.col("_hub") | F.col(key).isNull(), alone).otherwise(F.col(key)))
    rest = side.withColumnRenamed(key, "_key")
    out = out.join(rest.select("_key", F.struct(*[c for c in side.columns if c != key]).alias("_cold")), "_key", "left")
    return out.withColumns({c: F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")) for c in side.columns if c != key}).drop("_key", "_hub", "_hot", "_cold")


#: Bits of a map by which ``may_meet`` tells rows: 16 MB at most, however many keys there are.
MAP_BITS = 1 << 27


def may_meet(rows: DataFrame, *sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """The ``rows`` that may have their keys in one of the ``sides``, each (table, keys): all that have, and a few others.

    Rows stay where they are: a map of the hashes of each side's keys is broadcast. The more keys it holds the more others stay; none that has its keys there is lost.
    """
    out, hits = rows, []
    for k, (side, keys) in enumerate(sides):
        bit, of = F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS)) + 1, f"_of{k}"
        maps = side.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias(of)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias(f"_map{k}"))
        out = out.withColumn(of, F.bitmap_bucket_number(bit)).join(F.broadcast(maps), of, "left")
        at = F.bitmap_bit_position(bit)
        byte = F.conv(F.hex(F.substring(f"_map{k}", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return out.where(reduce(lambda a, b: a | b, hits)).select(*rows.columns)


def canonical_by_title(citations: DataFrame, index: DataFrame, linked: Column) -> DataFrame:
    """Citations (target_key, norm_title) that are not ``linked`` under the node that shares their title, if there is one."""
    rows = citations.withColumn("_title", F.when(~linked, F.col("norm_title")))
    rows = hub_join(rows, index.select(F.col("norm_title").alias("_title"), F.nullif("target", F.lit("")).alias("_t")), "_title", ["target_key", "norm_title"])
    return rows.withColumn("target_key", F.coalesce("_t", "target_key")).drop("_title", "_t")


def canonical_targets(citations: DataFrame, index: DataFrame) -> DataFrame:
    """Citations without a URL under the node that shares their title, if there is one."""
    rows = citations.withColumn("norm_title", X.norm_title(F.col("title")))
    return canonical_by_title(rows, index, F.coalesce(F.col("url"), F.lit("")) != "").drop("norm_title")


#: Bits of a place in reading order: phase, document, part of it, item, step.
BITS = {"doc": 31, "part": 2, "item": 28, "sub": 1}


def _seq(phase: Column, doc: Column, part: int, item: Column, sub: int) -> Column:
    """A place in reading order as one number: seeds before other documents, then by document, part, item and step."""
    fits = (doc >= 0) & (doc < 1 << BITS["doc"]) & (item >= 0) & (item < 1 << BITS["item"])
    place = phase.cast("long")
    for value, bits in zip((doc, F.lit(part), item, F.lit(sub)), BITS.values(), strict=True):
        place = F.shiftleft(place, bits) + value.cast("long")
    return F.when(fits, place).otherwise(F.raise_error(F.concat(F.lit("no place in reading order for document and item "), doc, F.lit(", "), item)))


def node_events(documents: DataFrame, citations: DataFrame, scripture: DataFrame) -> DataFrame:
    """(id, type, seq, parsed, is_source, fields..., cite, book, testament, ord): every touch of a node."""
    zero, phase = F.lit(0), F.when(F.col("is_source"), 0).otherwise(1)
    null = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    no_book = [*null("cite", "book", "testament"), F.lit(None).cast("int").alias("ord")]
    doc = documents.select(
        F.col("doc_key").alias("id"), F.lit("document").alias("type"), _seq(phase, F.col("doc_ord"), 0, zero, 0).alias("seq"), F.lit(True).alias("parsed"), "is_source",
        F.col("title").alias("label"), "title", "author", "author_key", "doc_type", "url", "date", *no_book,
    )
    person = lambda rows, part, item, sub: rows.where(given("author_key")).select(
        F.concat(F.lit("author:"), "author_key").alias("id"), F.lit("author").alias("type"), _seq(phase, F.col("doc_ord"), part, item, sub).alias("seq"), F.lit(False).alias("parsed"), F.lit(False).alias("is_source"),
        F.col("author").alias("label"), *null(*FIELDS[1:]), *no_book,
    )
    cited = citations.select(
        F.col("target_key").alias("id"), F.lit("document").alias("type"), _seq(phase, F.col("doc_ord"), 2, F.col("cite_seq"), 0).alias("seq"), F.lit(False).alias("parsed"), F.lit(False).alias("is_source"),
        F.col("title").alias("label"), "title", "author", "author_key", "doc_type", "url", *null("date"), *no_book,
    )
    passage = scripture.select(
        "id", F.lit("scripture").alias("type"), _seq(phase, F.col("doc_ord"), 3, F.col("ref_seq"), 0).alias("seq"), F.lit(False).alias("parsed"), F.lit(False).alias("is_source"),
        F.col("cite").alias("label"), *null(*FIELDS[1:]), "cite", "book", "testament", "ord",
    )
    return doc.unionByName(person(documents, 1, zero, 0)).unionByName(cited).unionByName(person(citations, 2, F.col("cite_seq"), 1)).unionByName(passage)


def _first(name: str) -> Column:
    return F.when(given(name), F.col("seq"))


def _firsts(events: DataFrame, fields: list[str]) -> DataFrame:
    """Per node the first value given of each field, its first type and place; partial firsts meet, not events."""
    first = lambda f: F.min_by(F.when(given(f), F.col(f)), _first(f)).alias(f)
    return events.groupBy("id").agg(F.min_by("type", "seq").alias("type"), *map(first, fields), F.max("is_source").alias("is_source"), F.min("seq").alias("first_seq"))


def _places(events: DataFrame, fields: list[str]) -> DataFrame:
    """(id, seq) of the events that ``_firsts`` takes something from; only numbers are merged."""
    places = events.groupBy("id").agg(F.min("seq").alias("_seq"), F.min(F.when(F.col("is_source"), F.col("seq"))).alias("_source"), *[F.min(_first(f)).alias(f) for f in fields])
    return places.select("id", F.explode(F.array_distinct(F.array("_seq", "_source", *fields))).alias("seq")).where("seq is not null")


def merge_nodes(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per node: of each field the first value given; a parsed document starts its fields anew. ``fields`` names those that are wanted, else all are.

    Events of parses and others are merged apart. Of a parsed document the last parse counts, and for fields it does not give the events behind it; only
    these events meet a table by node, if there is such a document at all. As events are read several times then, they are written once, and places are merged
    before texts: only events that may count are sorted or shuffled with their texts.
    """
    wanted = fields or [*FIELDS, *BOOK]
    fields, book = [f for f in FIELDS if f in wanted], [f for f in BOOK if f in wanted]
    both, any_of = [*fields, *book], lambda conditions: reduce(lambda a, b: a | b, conditions)
    told, parses = events.where(~F.col("parsed")), events.where("parsed")
    last = parses.groupBy("id").agg(
        F.max_by(F.struct(*both), "seq").alias("_own"), F.max("seq").alias("_last"), F.min("seq").alias("_from"), F.min_by("type", "seq").alias("_type"), F.max("is_source").alias("_source")
    )
    own = {f: F.when(given(f"_own.{f}"), F.col(f"_own.{f}")) for f in both}
    lacks = any_of(~given(f) for f in fields)
    if parses.where(lacks).isEmpty():
        out = _firsts(told, both).join(last, "id", "full")
        later = {f: F.lit(None) for f in fields}
    else:
        told = settle(told.select("id", "type", "seq", "is_source", *both), "told")
        lacking = parses.groupBy("id").agg(F.max("seq").alias("_last"), F.max_by(lacks, "seq").alias("_lacks")).where("_lacks").drop("_lacks")
        told = settle(may_meet(told, (_places(told, both), ["id", "seq"]), (lacking, ["id"])), "told-first")
        rows = hub_join(told.where(any_of(map(given, fields))), lacking, "id", ["id", "seq"]).where(F.col("seq") >= F.col("_last")).drop("_last")
        out = _firsts(told, both).join(last, "id", "full").join(_firsts(rows, fields).select("id", F.struct(*fields).alias("_later")), "id", "left")
        later = {f: F.col(f"_later.{f}") for f in fields}
    parsed = F.col("_last").isNotNull()
    before = F.col("first_seq").isNull() | (F.col("_from") < F.col("first_seq"))
    # What stands in no page of its own keeps its first values.
    out = out.select(
        "id", F.when(parsed & before, F.col("_type")).otherwise(F.col("type")).alias("type"), *[F.when(parsed, F.coalesce(own[f], later[f])).otherwise(F.col(f)).alias(f) for f in fields],
        parsed.alias("in_corpus"), F.coalesce(F.greatest("is_source", "_source"), F.lit(False)).alias("is_source"),
        *[F.when(parsed & before, F.coalesce(own[f], F.col(f))).otherwise(F.coalesce(F.col(f), own[f])).alias(f) for f in book], F.least("first_seq", "_from").alias("first_seq"),
    )
    # A person's name is its label's text.
    return out.withColumn("name", F.when(F.col("type") == "author", F.col("label"))) if "label" in fields else out


def edge_events(documents: DataFrame, citations: DataFrame, scripture: DataFrame) -> DataFrame:
    """(source, target, type, n, seq): every touch of an edge."""
    phase, one = F.when(F.col("is_source"), 0).otherwise(1), F.lit(1).cast("long").alias("n")
    author = F.concat(F.lit("author:"), "author_key").alias("target")
    a = documents.where(given("author_key")).select(F.col("doc_key").alias("source"), author, F.lit("authored_by").alias("type"), one, _seq(phase, F.col("doc_ord"), 1, F.lit(0), 0).alias("seq"))
    b = citations.select(F.col("doc_key").alias("source"), F.col("target_key").alias("target"), F.lit("cites").alias("type"), one, _seq(phase, F.col("doc_ord"), 2, F.col("cite_seq"), 0).alias("seq"))
    c = citations.where(given("author_key")).select(F.col("target_key").alias("source"), author, F.lit("authored_by").alias("type"), one, _seq(phase, F.col("doc_ord"), 2, F.col("cite_seq"), 1).alias("seq"))
    d = scripture.select(F.col("doc_key").alias("source"), F.col("id").alias("target"), F.lit("cites_scripture").alias("type"), F.col("cnt").cast("long").alias("n"), _seq(phase, F.col("doc_ord"), 3, F.col("ref_seq"), 0).alias("seq"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def merge_edges(events: DataFrame) -> DataFrame:
    """(source, target, type, weight, first_seq), without loops."""
    return events.where("source <> target").groupBy("source", "target", "type").agg(F.sum("n").alias("weight"), F.min("seq").alias("first_seq"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): the weights of a node's edges, both ways."""
    ends = F.explode(F.array("source", "target")).alias("id")
    return edges.select(ends, "weight").groupBy("id").agg(F.sum("weight").alias("degree"))


def enrich(nodes: DataFrame, edges: DataFrame, pontiffs: DataFrame | None = None, spans: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Nodes with flags, year, degree, and for persons the pontiff's record and the span of time.

    The library's own dimensions have a fixed number of rows and are broadcast; tables given instead may have any size and are joined as such.
    """
    spark = nodes.sparkSession
    fixed = lambda table, given_: table if given_ is not None else F.broadcast(table)
    doc = F.col("type") == "document"
    flag = lambda c: F.when(doc, F.coalesce(c, F.lit(False))).alias(c)
    rows = nodes.join(degrees(edges), "id", "left")
    keep = [c for c in nodes.columns if c not in ("in_corpus", "is_source")]
    rows = rows.select(*keep, flag("in_corpus"), flag("is_source"), F.when(doc, X.year_of(F.col("date"), F.col("url"))).alias("year"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    key = F.when(F.col("type") == "author", F.lower(F.regexp_replace("id", "^author:", "")))
    p = pontiff_records(pontiffs if pontiffs is not None else dims.pontiffs(spark)).select(F.col("author_key").alias("_key"), F.struct("ordinal", "ordinal_label", "display_name", "reign_label", "reign_start", "reign_end", "profile_url", "encyclopedia_url").alias("pontiff"))
    s = spans if spans is not None else dims.spans(spark)
    a = aliases if aliases is not None else dims.span_aliases(spark)
    rows = rows.withColumn("_key", F.trim(key)).join(fixed(p, pontiffs), "_key", "left").join(fixed(a.select(F.col("variant").alias("_key"), F.col("span_key").alias("_alias")), aliases), "_key", "left")
    rows = rows.withColumn("_alias", F.coalesce("_alias", "_key")).join(fixed(s.select(F.col("span_key").alias("_alias"), F.struct("kind", "start", "end", "label").alias("_span")), spans), "_alias", "left")
    own = F.coalesce(F.nullif("label", F.lit("")), F.col("pontiff.display_name"))
    reign = F.struct(F.lit("reign").alias("kind"), F.col("pontiff.reign_start").alias("start"), F.col("pontiff.reign_end").alias("end"), own.alias("label"))
    life = F.struct(F.col("_span.kind").alias("kind"), F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.coalesce(F.nullif("_span.label", F.lit("")), "label").alias("label"))
    return rows.withColumn("span", F.when(F.col("pontiff").isNotNull(), reign).when(F.col("_span").isNotNull(), life)).drop("_key", "_alias", "_span")


def pontiff_records(pontiffs: DataFrame) -> DataFrame:
    return pontiffs.withColumn("ordinal_label", F.concat(X.ordinal_label(F.col("ordinal")), F.lit(" Pontiff"))).withColumn("reign_label", X.reign_label(F.col("reign_start"), F.col("reign_end")))


def meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, in_corpus, authors, scripture, edges."""
    of = lambda t: F.count_if(F.col("type") == t)
    counts = nodes.agg(of("document").alias("documents"), F.count_if("in_corpus").alias("in_corpus"), of("author").alias("authors"), of("scripture").alias("scripture"))
    return counts.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row by one row


def frontier(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """(doc_key, url): documents of the second layer that the seeds cite and that aren't parsed yet, by first citation."""
    seeds = documents.where("is_source").select("doc_key")
    rows = citations.where("is_source").where(U.is_layer2(F.col("url")))
    url = U.strip_fragment(F.replace(F.col("url"), F.lit("https://w2.vatican.va"), F.lit("https://www.vatican.va")))
    rows = rows.select(url.alias("url"), F.struct("doc_ord", "cite_seq").alias("seq")).withColumn("doc_key", U.doc_key(F.col("url")))
    first = rows.groupBy("doc_key").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
    return first.join(seeds, "doc_key", "left_anti").select("doc_key", "url", "seq")


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows hold each value, nulls under <none>."""
    return rows.groupBy(F.coalesce(F.col(key), F.lit("<none>")).alias(key)).agg(F.count("*").alias("n"))


def legend(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(X.category(F.col("is_source"), F.col("type")).alias("category")).agg(F.count("*").alias("n"))


def year_window(nodes: DataFrame, this_year: int, default: tuple[int, int] = (1500, 2030)) -> DataFrame:
    """(year_min, year_max): the seeds' first decade, and a year after the last document or this year."""
    doc = (F.col("type") == "document") & (F.coalesce("year", F.lit(0)) > 0)
    low = F.min(F.when(doc & F.coalesce("is_source", F.lit(False)), F.col("year")))
    high = F.max(F.when(doc, F.col("year")))
    return nodes.agg(
        F.coalesce((F.floor(low / 10) * 10).cast("int"), F.lit(default[0])).alias("year_min"),
        F.coalesce((F.greatest(high, F.lit(this_year)) + 1).cast("int"), F.lit(default[1])).alias("year_max"),
    )


def missing_slugs(curated: DataFrame, page: DataFrame, pattern: str) -> DataFrame:
    """Curated slugs that an index page doesn't link to."""
    found = page.select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("slug")).distinct()
    return curated.where("slug is not null").select("slug").distinct().join(found, "slug", "left_anti")


def force_weights(edges: DataFrame) -> DataFrame:
    """(a, b, w) of each unordered pair: of several edges the last one's force."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by(_force(), "first_seq").alias("w"))


def _force() -> Column:
    kind = F.when(F.col("type") == "cites", 1.0).when(F.col("type") == "authored_by", 0.4).when(F.col("type") == "cites_scripture", 0.3).otherwise(1.0)
    return kind * (1 + 0.15 * (F.col("weight") - 1))


def event_forces(events: DataFrame) -> DataFrame:
    """``force_weights`` of the merged ``events``: they are dealt by pair once, and edges and pairs are merged where they lie."""
    ahead = (F.col("source") < F.col("target")).alias("ahead")
    rows = events.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), ahead, "type", "n", "seq").repartition("a", "b")
    edges = rows.groupBy("a", "b", "ahead", "type").agg(F.sum("n").alias("weight"), F.min("seq").alias("first_seq"))
    return edges.groupBy("a", "b").agg(F.max_by(_force(), "first_seq").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(id, neighbour), each pair once either way."""
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().select(F.col("source").alias("id"), F.col("target").alias("neighbour"))
