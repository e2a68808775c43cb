"""A lenient lexer for pages: tokens, blocks, links, italics, metadata.

``tokens`` is the one wide operator: a row for each tag and text run, numbered in page order, with the paragraph, link and italic it is in. A page's tokens
are numbered where it is read, so no later operator sorts or shuffles them to find out where they stand; all read only the columns they need.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glossa.functions import text as X
from glossa.functions import url as U

BLOCKS = ["p", "div", "td", "tr", "table", "li", "ul", "ol", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "body", "article", "footer", "nav"]
_ENDS = frozenset(BLOCKS)


def decode(text: Column, names: dict[str, int] | None = None) -> Column:
    """Character references decoded as browsers do, also unended ones: an Arrow function, for the few texts that have any.

    With ``names`` only these, ended by a semicolon, one name after the other in their order.
    """
    if names is not None:
        for name, sign in names.items():
            text = F.replace(text, F.lit(f"&{name};"), F.lit(chr(sign)))
        return text

    @F.arrow_udf("string")
    def unescape(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())

    return F.when(text.contains("&"), unescape(text)).otherwise(text)


#: Text, a tag with its name and attributes, or the start of something else. Matched up to the last ">", so every tag ends.
_PIECE = re.compile(r"([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s+([^>]*)|[^>]*)>|<!--|<")
_UNSEEN = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}


def _pieces(page: str) -> Iterator[tuple[str | None, str, str]]:
    """A page's tags (name, raw, attributes) and texts (None, text, "") in order. Comments, scripts and styles are left out, a "<" that opens nothing is text.

    What is not closed in the rest of the page is looked for once, so a page takes time in proportion to its length.
    """
    at, last, text, gone = 0, page.rfind(">") + 1, [], set()
    match = _PIECE.match
    while at < last:
        found = match(page, at, last)
        run, slash, name, attrs = found.groups()
        if run:
            text.append(run)
            at = found.end()
            continue
        if name:
            name, raw = name.lower(), found[0]
            at = found.end()
            if name in _UNSEEN and not slash and name not in gone:
                if shut := _UNSEEN[name].search(page, at):
                    at = shut.end()
                    continue
                gone.add(name)
            attrs = "" if slash or not attrs else attrs.removesuffix("/")
        else:
            if found[0] == "<!--" and "-->" not in gone:
                if (end := page.find("-->", at)) >= 0:
                    at = end + 3
                    continue
                gone.add("-->")
            if page[at + 1 : at + 2] not in ("/", "!", "?"):
                text.append("<")
                at += 1
                continue
            end = page.find(">", at) + 1
            name, raw, attrs, at = "", page[at:end], "", end
        if text:
            yield None, "".join(text), ""
            text = []
        yield name, raw, attrs
    text.append(page[at:])
    if whole := "".join(text):
        yield None, whole, ""


def lex(page: str) -> Iterator[tuple[str | None, str]]:
    """A page's tags (name, raw) and texts (None, text) in order."""
    return (piece[:2] for piece in _pieces(page))


def _of_page(text: str) -> Iterator[tuple]:
    """A page's tokens with their paragraph, link and italic, as ``tokens`` tells them."""
    block = at = anchor = italic = 0
    before = None
    for seq, (name, raw, attrs) in enumerate(_pieces(text)):
        if name is None:
            yield seq, "text", None, False, None, raw, at, anchor, italic, before == "title"
            continue
        closing = raw[1] == "/"
        if name == "a":
            anchor += 1
        elif name == "i":
            italic += 1
        elif name == "p" and not closing:
            at = block = block + 1
        elif name in _ENDS:
            at = 0
        before = None if closing else name
        yield seq, "tag", name, closing, attrs, None, at, anchor, italic, False


def _read(pages: DataFrame, keys: list[str], page: str, columns: str, rows_of: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """``keys`` of each page with the rows that ``rows_of`` makes of its text; they leave in batches."""
    base = pages.select(*keys, F.col(page).alias("_page"))
    own = StructType.fromDDL(columns)
    schema = StructType([*base.select(*keys).schema.fields, *own.fields])
    kinds = list(to_arrow_schema(own).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners = [], []

            def full(batch: pa.RecordBatch) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)  # noqa: B023
                at = pa.array(owners, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

            for k, text in enumerate(batch.column("_page")):
                for row in rows_of(text.as_py() or ""):
                    rows.append(row)
                    owners.append(k)
                    if len(rows) == 20_000:
                        yield full(batch)
                        rows.clear(), owners.clear()
            yield full(batch)

    return base.mapInArrow(run, schema)


def tokens(pages: DataFrame, key: str = "url", page: str = "html") -> DataFrame:
    """(key, seq, kind 'tag' or 'text', tag, closing, attrs, text, block, anchor, italic, titled) of each token.

    ``block`` counts paragraph starts, 0 outside: a paragraph ends at its end tag, at the next block-level tag and at the page's end. ``anchor`` and
    ``italic`` count the tags of links and italics so far, start and end; ``titled`` texts follow a title's start.
    """
    columns = "seq int, kind string, tag string, closing boolean, attrs string, text string, block long, anchor long, italic long, titled boolean"
    return _read(pages, [key], page, columns, _of_page)


def _said(parts: list[str]) -> str:
    """Text runs decoded, a space between."""
    return html.unescape(" ".join(parts))


def _paragraph(tokens_: Iterator[tuple]) -> tuple:
    runs, found = [], {"a": [], "i": []}
    opened: dict[str, list[str]] = {}
    first = None
    for seq, kind, tag, closing, attrs, text, *_ in tokens_:
        first = seq if first is None else first
        if kind == "text":
            for parts in opened.values():
                parts.append(text)
            runs.append(text)
        elif tag in found:
            opened.pop(tag, None)
            if not closing:
                opened[tag] = []
                found[tag].append((seq, attrs, len(runs), opened[tag]))
    return first, _said(runs), runs, [(seq, attrs, n, _said(parts)) for seq, attrs, n, parts in found["a"]], [(seq, _said(parts)) for seq, _, _, parts in found["i"]]


def paragraphs(pages: DataFrame, keys: list[str], page: str = "html", whole: bool = False) -> DataFrame:
    """(keys, block, first_seq, text, runs, links, italics) of each paragraph, made where its page is read: no token leaves the task for it.

    ``text`` holds the text runs decoded, a space between, ``runs`` as they stand; links and italics have their text as far as the paragraph goes, ``before`` runs stand
    before a link. White space stays as it is. With ``whole`` a page is one paragraph.
    """

    def rows_of(text: str) -> Iterator[tuple]:
        for block, inside in groupby(_of_page(text), (lambda t: 1) if whole else itemgetter(6)):
            if block:
                yield block, *_paragraph(inside)

    columns = "block long, first_seq int, text string, runs array<string>, links array<struct<seq:int,attrs:string,before:int,text:string>>, italics array<struct<seq:int,text:string>>"
    return _read(pages, keys, page, columns, rows_of)


def page_links(pages: DataFrame, key: str = "url", page: str = "html") -> DataFrame:
    """``links`` of pages, made where they are read: no token leaves the task for it."""

    def rows_of(text: str) -> Iterator[tuple]:
        link, parts = None, []
        for seq, kind, tag, closing, attrs, said, block, *_ in _of_page(text):
            if tag == "a":
                if link:
                    yield *link, _said(parts)
                link, parts = None if closing else (block, seq, attrs), []
            elif link and kind == "text":
                parts.append(said)
        if link:
            yield *link, _said(parts)

    rows = _read(pages, [key], page, "block long, seq int, attrs string, text string", rows_of)
    return rows.select(key, "block", "seq", attribute(F.col("attrs"), "href").alias("href"), attribute(F.col("attrs"), "name").alias("name"), X.squeeze(F.col("text")).alias("text"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, decoded; null where it is missing."""
    double = F.regexp_extract(attrs, rf'(?is)(?:^|\s){name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(attrs, rf"(?is)(?:^|\s){name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(attrs, rf"(?is)(?:^|\s){name}\s*=\s*([^\s\"'>]+)", 1)
    value = F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")), F.nullif(bare, F.lit("")))
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def texts(pages: DataFrame, key: str = "url", page: str = "html") -> DataFrame:
    """``page_text`` of pages, made where they are read; pages without a text run have no row."""

    def rows_of(text: str) -> Iterator[tuple]:
        runs = [raw for name, raw, _ in _pieces(text) if name is None]
        if runs:
            yield (_said(runs),)

    return _read(pages, [key], page, "text string", rows_of)


def in_head() -> Column:
    """The tokens that ``meta`` reads, and each page's first, so that no page is lost."""
    return F.col("titled") | (F.col("seq") == 0) | (F.coalesce(F.col("tag").isin("link", "meta"), F.lit(False)) & ~F.col("closing"))


def page_text(tokens_: DataFrame, key: str = "url", names: dict[str, int] | None = None) -> DataFrame:
    """(key, text) of whole pages: the text runs in order, a space between; ``names`` as in ``decode``."""
    runs = tokens_.where("kind = 'text'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("r"))
    return runs.select(key, decode(F.array_join(F.transform("r", lambda x: x["text"]), " "), names).alias("text"))


def links(tokens_: DataFrame, key: str = "url") -> DataFrame:
    """(key, block, seq, href, name, text) of every anchor, with the text up to its end tag."""
    opens = (F.col("tag") == "a") & ~F.col("closing")
    parts = tokens_.groupBy(key, "anchor").agg(
        F.min(F.when(opens, F.struct("seq", "block", "attrs"))).alias("o"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", "text")))).alias("t"),
    )
    parts = parts.where("o is not null")
    text = X.squeeze(decode(F.array_join(F.transform("t", lambda x: x["text"]), " ")))
    return parts.select(key, F.col("o.block").alias("block"), F.col("o.seq").alias("seq"), attribute(F.col("o.attrs"), "href").alias("href"), attribute(F.col("o.attrs"), "name").alias("name"), text.alias("text"))


def document_links(links_: DataFrame, key: str = "url") -> DataFrame:
    """The links of each block that lead to documents, by order, each address once; back-links to notes don't count."""
    back = F.col("href").rlike(r"#_(?:ftn|edn)ref\d+")
    good = links_.where(F.col("href").isNotNull() & ~F.col("href").startswith("#") & ~back & U.is_document(F.col("href")))
    first = F.row_number().over(Window.partitionBy(key, "block", "href").orderBy("seq"))
    return good.withColumn("_n", first).where("_n = 1").drop("_n", "name")


def meta(tokens_: DataFrame, key: str = "url", names: dict[str, int] | None = None) -> DataFrame:
    """(key, canonical, og_url, description, raw_title) of each page that has any token; ``names`` as in ``decode``."""
    a = F.col("attrs")
    tag = lambda t: (F.col("tag") == t) & ~F.col("closing")
    named = lambda kind, value: tag("meta") & (F.lower(attribute(a, kind)) == value)
    first = lambda cond, value: F.min(F.when(cond & value.isNotNull(), F.struct("seq", value.alias("v"))))["v"]
    content = X.strip(attribute(a, "content"))
    out = tokens_.groupBy(key).agg(
        first(tag("link") & (F.lower(attribute(a, "rel")) == "canonical"), attribute(a, "href")).alias("canonical"),
        first(named("property", "og:url"), content).alias("og_url"),
        F.coalesce(first(named("name", "description"), content), first(named("property", "og:description"), content)).alias("description"),
        first(F.col("titled"), F.col("text")).alias("raw_title"),
    )
    return out.withColumn("raw_title", X.squeeze(decode(F.coalesce("raw_title", F.lit("")), names))).withColumn("description", decode(F.col("description"), names))


def canonical_url(canonical: Column, og_url: Column, source: Column) -> Column:
    blank = F.lit("")
    return U.alias_host(F.coalesce(F.nullif(canonical, blank), F.nullif(og_url, blank), source))


def block_text(tokens_: DataFrame, key: str = "url") -> DataFrame:
    """(key, block, text, first_seq) of every paragraph: its text runs, a space between, white space single."""
    rows = tokens_.where("block > 0").groupBy(key, "block").agg(F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", "text")))).alias("t"))
    return rows.select(key, "block", "first_seq", X.squeeze(decode(F.array_join(F.transform("t", lambda x: X.strip(x["text"])), " "))).alias("text"))
