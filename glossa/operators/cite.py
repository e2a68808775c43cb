"""Citations from notes: features in parallel, then running states over each document's notes for "ibid." and "idem"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import dims
from glossa.functions import text as X
from glossa.functions import url as U
from glossa.operators import scan


def note_features(notes: DataFrame, source: Column | None = None) -> DataFrame:
    """Per note, what the fold needs: is_ibid, is_idem, own author, key and type, links with keys and types, first title."""
    source = F.lit("") if source is None else source
    rows = notes.withColumn("_text", X.drop_orphans(X.strip_marker(F.col("text"), F.col("number"))))
    comma = lambda lead: F.when(X.detect_type(lead)["at"] >= 0, lead).otherwise(F.element_at(F.split(lead, r"(?U)\s*[,:]\s*", 2), 1))
    head = X.let(X.clean_lead(F.col("_text")), comma)
    linked = F.size("links") > 0
    own = X.author_type(F.when(linked, X.strip_marker(F.coalesce("prefix", F.lit("")), F.col("number"))).otherwise(head))
    full = F.transform(
        "links",
        lambda x: F.struct(
            U.doc_key(U.resolve(source, x["url"])).alias("target_key"), X.strip(x["txt"]).alias("title"),
            F.replace(U.resolve(source, x["url"]), F.lit("http://"), F.lit("https://")).alias("url"),
        ),
    )
    return (
        rows.withColumn("is_ibid", F.col("_text").rlike(r"(?iU)^\s*(cf\.?\s*)?ibid\b"))
        .withColumn("is_idem", F.col("_text").rlike(r"(?iU)^\s*(cf\.?\s*)?(idem|id)\b\.?"))
        .withColumn("own", own).withColumn("full", full).withColumn("first_title", X.first_title(F.col("italics")))
        .drop("_text")
    )


def _work(key: Column, title: Column, url: Column, author: Column, author_key: Column, doc_type: Column) -> Column:
    parts = {"target_key": key, "title": title, "url": url, "author": author, "author_key": author_key, "doc_type": doc_type}
    return F.struct(*[c.cast("string").alias(n) for n, c in parts.items()])


def fold(features: DataFrame, key: str = "url", size: int = scan.BLOCK) -> DataFrame:
    """(key, cite_seq, footnote, target_key, title, url, author, author_key, doc_type) of every citation, in note order.

    "Ibid." means the last work named before it, "idem" its author. What a note leaves to the next one is the last value of each of the work's fields,
    each by a running state over the document's notes (``scan.running``), so a document may have any number of notes:

    * whether any note has named a work: before that "ibid." means nothing;
    * the author: of the last note that names its own, until a bound note's title is that author's name, which then was none;
    * the title: of the last note with one of its own, else the first address that gave one;
    * the type: of the last note that isn't "ibid.", else the first that a title of its successors tells;
    * the address: of the last note that named a work; a work without one has a key made of author and title.
    """
    n = F.col
    linked, titled = F.size("full") > 0, n("first_title").isNotNull()
    same = lambda author: F.coalesce(F.lower(F.trim(author)) == F.lower(F.trim(n("first_title"))), F.lit(False))
    unnamed = lambda x: (x["title"] == "") | x["title"].rlike(r"(?iU)\bibid\b")
    bound = n("is_ibid") | n("is_idem") | F.coalesce(n("own.author_key").isin("ibid", "idem", "id"), F.lit(False))
    rows = features.select(key, "note_seq", "number", "is_ibid", "own", "full", "first_title", bound.alias("bound"), linked.alias("linked"), titled.alias("titled"))
    rows = scan.blocks(rows.where(n(key).isNotNull()), "note_seq", size)
    step = lambda df, states, sums=None: scan.running(df, [key], "note_seq", states, sums, size, store="notes-enter")
    # Whether a note before has named a work needs no value: a flag a block tells it, so no row is dealt for it.
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    named = n("linked") | n("titled")
    some = rows.groupBy(key, "_block").agg(F.max(named).alias("_named")).select(key, "_block", F.max("_named").over(earlier([key], "_block")).alias("_some")).where("_some")
    rows = rows.join(some.hint("shuffle_hash"), [key, "_block"], "left")
    rows = rows.withColumn("_some", F.coalesce("_some", F.max(named).over(earlier([key, "_block"], "note_seq")), F.lit(False)))
    follows = n("is_ibid") & n("_some")
    rows = rows.withColumns({"follows": follows, "again": ~n("linked") & follows, "sets": n("linked") | n("titled") & ~follows}).drop("_some")
    nobody = F.struct(F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("author_key"))
    own = F.when(~n("linked") & same(n("own.author")), nobody).otherwise(F.struct("own.author", "own.author_key"))
    first = F.try_element_at("full", F.lit(1))
    title = F.when(~n("linked"), n("first_title")).when(~unnamed(first), first["title"])
    number = F.when(n("linked"), F.size("full")).when(n("again") | n("titled"), 1).otherwise(0)
    rows = step(
        rows,
        {"who": (None, F.when(n("sets") & ~n("bound"), own)), "name": (n("sets") & title.isNotNull(), F.when(n("sets"), F.coalesce(title, F.nullif(U.slug_title(first["target_key"]), F.lit(""))))), "at": (None, F.when(n("sets"), F.struct(n("linked").alias("linked"), first["target_key"].alias("key"), first["url"].alias("url"))))},
        {"cite_seq": number},
    )
    told = F.when(n("linked"), X.detect_type(n("name"))["type"])
    starts = n("sets") & ~n("follows")
    rows = step(
        rows,
        {"dead": (n("sets") & ~n("bound"), F.when(n("sets") & n("bound") & ~n("linked") & same(n("who.author")), True)), "kind": (starts, F.when(n("sets"), F.when(starts, F.coalesce("own.doc_type", told)).otherwise(told)))},
    )
    author = lambda at, f: F.when(n(f"dead{at}").isNull(), n(f"who{at}.{f}"))
    key_of = lambda at, title: F.when(n(f"at{at}.linked"), n(f"at{at}.key")).otherwise(X.text_key(author(at, "author_key"), title))
    mine = lambda f: F.when(n("bound"), author("_before", f)).otherwise(n(f"own.{f}"))

    def link(x: Column) -> Column:
        shown = F.when(unnamed(x), F.coalesce("name_before", U.slug_title(x["target_key"]))).otherwise(x["title"])
        type_ = F.when(n("follows"), n("kind_before")).otherwise(n("own.doc_type"))
        return X.let(shown, lambda t: _work(x["target_key"], t, x["url"], mine("author"), mine("author_key"), F.coalesce(type_, X.detect_type(t)["type"])))

    before = _work(key_of("_before", n("name_before")), n("name_before"), n("at_before.url"), author("_before", "author"), author("_before", "author_key"), n("kind_before"))
    named = _work(key_of("", n("first_title")), n("first_title"), F.lit(None), author("", "author"), author("", "author_key"), n("kind"))
    made = F.when(n("linked"), F.transform("full", link)).when(n("again"), F.array(before)).when(n("titled"), F.array(named))
    rows = rows.select(key, n("cite_seq").alias("_from"), n("number").cast("int").alias("footnote"), F.posexplode(made).alias("_k", "c"))
    return rows.select(key, (n("_from") + n("_k")).cast("int").alias("cite_seq"), "footnote", "c.*")


def lookup_work(title: Column) -> Column:
    """struct(work_title, work_author, work_type) of the first curated work whose pattern the normalised title contains; null without one."""
    works = dims.records(dims.WORKS)
    known = lambda norm: F.coalesce(*[F.when(norm.contains(p), F.struct(F.lit(t).alias("work_title"), F.lit(a).alias("work_author"), F.lit(k).alias("work_type"))) for p, t, a, k in works])
    return X.let(X.norm_title(title), known)


def canonicalise(citations: DataFrame) -> DataFrame:
    """Citations of curated works under their canonical title, author and type; those without a URL also under its key."""
    w = F.col("_w")
    known = w.isNotNull()
    pick = lambda new, old: F.when(known, new).otherwise(F.col(old)).alias(old)
    rest = [c for c in citations.columns if c not in ("target_key", "title", "author", "author_key", "doc_type")]
    return citations.withColumn("_w", lookup_work(F.col("title"))).select(
        *rest, pick(F.when(F.col("url").isNull(), X.work_key(w["work_title"])).otherwise(F.col("target_key")), "target_key"), pick(w["work_title"], "title"),
        pick(w["work_author"], "author"), pick(X.author_key(w["work_author"]), "author_key"), pick(w["work_type"], "doc_type"),
    )
