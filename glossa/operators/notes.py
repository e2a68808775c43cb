"""Notes of a page, by four strategies, the first that finds any."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossa.functions import text as X
from glossa.functions import url as U
from glossa.operators import html as H

BACK = r"#_(?:ftn|edn)ref\d+"


def anchor_notes(links: DataFrame, key: str = "url") -> DataFrame:
    """(key, block, note_seq, number): blocks of note anchors that lead back to the text; the number is the back-link's first digits."""
    back = F.col("href").rlike(BACK)
    number = F.try_to_number(F.regexp_extract("href", r"\d+", 0), F.lit("999999999999")).cast("long")
    led = links.where(back & (F.col("block") > 0)).select(key, "block", "seq", number.alias("number"), F.col("name").rlike(r"^_(?:ftn|edn)\d+$").alias("named"))
    rows = led.groupBy(key, "block").agg(F.min(F.when(F.col("named"), F.col("seq"))).alias("at"), F.min_by("number", "seq").cast("int").alias("number")).where("at is not null")
    order = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return rows.where("number is not null").select(key, "block", order.alias("note_seq"), "number")


def section_notes(blocks: DataFrame, key: str = "url") -> DataFrame:
    """(key, block, note_seq, number): the paragraphs after a NOTES heading that start with a number, if the first one is 1."""
    head = blocks.where(F.upper(F.regexp_replace("text", r"(?U)\s", "")) == "NOTES").groupBy(key).agg(F.min("block").alias("head"))
    number = F.regexp_extract("text", r"(?U)^\s*(\d{1,3})\s*[.\s]", 1)
    # Numbers are read before the join, so that no text goes through it.
    rows = blocks.where(number != "").select(key, "block", number.cast("int").alias("number")).join(head.hint("merge"), key).where("block > head")
    in_page = Window.partitionBy(key).orderBy("block")
    rows = rows.withColumn("first", F.first("number").over(in_page)).withColumn("note_seq", F.row_number().over(in_page) - 1)
    return rows.where("first = 1").select(key, "block", "note_seq", "number")


def bracket_notes(blocks: DataFrame, key: str = "url", least: int = 20) -> DataFrame:
    """(key, block, note_seq, number): the paragraphs that start with [N], if there are enough and N never falls."""
    number = F.regexp_extract("text", r"(?U)^\s*\[(\d{1,4})\]", 1)
    in_page, page = Window.partitionBy(key).orderBy("block"), Window.partitionBy(key)
    rows = blocks.where(number != "").withColumn("number", number.cast("int"))
    falls = F.coalesce((F.col("number") < F.lag("number").over(in_page)).cast("int"), F.lit(0))
    rows = rows.withColumn("falls", falls).withColumn("note_seq", F.row_number().over(in_page) - 1)
    rows = rows.withColumn("n", F.count("*").over(page)).withColumn("bad", F.sum("falls").over(page))
    return rows.where((F.col("n") >= least) & (F.col("bad") == 0)).select(key, "block", "note_seq", "number")


# Elements whose tags end a line, so that a number after them may start a note.
BREAKS = frozenset("p br div hr td tr table li font".split())


# What a page's footer starts with, each with what follows it; case does not count, nor white space between the two.
REGION_ENDS = [("<footer", [""]), ("<!--", ["end:body"]), ("copyright", ["©", "&copy;", "&#169;"])]


def _before(text, sign: str, follows: list[str]):
    """What stands before the first ``sign`` that one of ``follows`` follows."""
    def cut(parts):
        bare = lambda x: F.lower(F.regexp_replace(F.substring(x, 1, 200), r"(?U)\s", ""))
        here = lambda i: (i > 0) & reduce(lambda a, b: a | b, [bare(parts[i]).startswith(f) for f in follows])
        at = F.array_min(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), here))
        length = F.aggregate(F.slice(parts, F.lit(1), at), F.lit(0), lambda n, x: n + F.length(x)) + (at - 1) * len(sign)
        return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), length))

    return X.let(F.split(text, "(?i)" + re.escape(sign)), cut)


def notes_region(page):
    """What follows a page's last rule, up to its footer."""
    behind = F.substring_index(page, "<hr", -1)
    behind = F.substring(behind, F.instr(behind, ">") + 1, F.length(behind))
    region = reduce(lambda t, end: X.let(t, lambda x: _before(x, *end)), REGION_ENDS, behind)
    return F.when(page.contains("<hr"), region).otherwise("")


class _Region:
    """The pieces of an old page's notes: tags and texts, and for each text whether it opens a line."""

    def __init__(self, html: str):
        pieces = self._plain_bookmarks(self._cut(html))
        self.pieces: list[str] = self._cut("".join(pieces))
        self.opens: list[bool] = []
        line = True
        for piece in self.pieces:
            name = self._name(piece)
            self.opens.append(line and name is None)
            line = True if name in BREAKS else line and (name is not None or not piece.strip())

    @staticmethod
    def _cut(html: str) -> list[str]:
        return re.findall(r"<[^>]+>|[^<]+|<", html)

    @staticmethod
    def _name(piece: str) -> str | None:
        """A tag's name; None for text."""
        words = piece.strip("<>/ \t\n").split() if piece[:1] == "<" and piece[-1:] == ">" else None
        return words and words[0].rstrip("/").lower()

    def _plain_bookmarks(self, pieces: list[str]) -> list[str]:
        """A bookmark anchor around a number, or around nothing, becomes the bare number."""
        out, i = [], 0
        while i < len(pieces):
            if self._name(pieces[i]) == "a" and pieces[i][1] != "/" and ('name="' in pieces[i] or 'href="#' in pieces[i]):
                text = pieces[i + 1].strip() if i + 1 < len(pieces) and self._name(pieces[i + 1]) is None else ""
                close = i + 1 if i + 1 < len(pieces) and self._name(pieces[i + 1]) is not None else i + 2
                if (not text or text.isdecimal()) and "".join(pieces[close : close + 1]) == "</a>":
                    out.append(f" {text} ")
                    i = close + 1
                    continue
            out.append(pieces[i])
            i += 1
        return out

    def candidates(self) -> dict[str, list[tuple[int, int, int, bool]]]:
        """For each number written somewhere its possible markers in order: piece, start, end, whether it opens a line.

        A number looks no further than the white space and signs next to it, so a region takes time in proportion to its length.
        """
        found: dict[str, list[tuple[int, int, int, bool]]] = {}
        for k, piece in enumerate(self.pieces):
            if self._name(piece) is not None:
                continue
            heads = self._heads_end(piece) if self.opens[k] else -1
            for m in re.finditer(r"\d+", piece):
                if m.start() <= heads and self._heads(piece[: m.start()]):
                    found.setdefault(m[0], []).append((k, 0, self._trail(piece, m.end()), True))
                mark = self._white(piece, m.end())
                if mark > m.end() and piece[mark : mark + 1] in (")", "."):
                    found.setdefault(m[0], []).append((k, m.start(), mark + 1, False))
        return found

    @staticmethod
    def _heads_end(piece: str) -> int:
        """Where the signs end that may stand before a number on its line: a section's number of up to four signs and a bracket."""
        seen = 0
        for at, sign in enumerate(piece):
            seen += not sign.isspace()
            if seen > 5:
                return at
        return len(piece)

    @staticmethod
    def _heads(before: str) -> bool:
        """Whether only a bracket, or a section's number and a bracket, stands before a number on its line."""
        bare = before.replace("(", "", 1)
        words = bare.split()
        if not words:
            return True
        section = len(words) == 1 and len(words[0]) <= 4 and words[0][:-1].isdecimal() and words[0][-1] in ".)"
        return section and bare[-1].isspace() and before.split()[0] == words[0]

    @staticmethod
    def _white(piece: str, at: int) -> int:
        """Where the white space at ``at`` ends."""
        while at < len(piece) and piece[at].isspace():
            at += 1
        return at

    @classmethod
    def _trail(cls, piece: str, at: int) -> int:
        """Where a marker ends whose number ends at ``at``: behind a bracket and a point, white space before each."""
        ends = [at, cls._white(piece, at)]
        ends.append(ends[-1] + piece.startswith(")", ends[-1]))
        ends.append(cls._white(piece, ends[-1]))
        ends.append(ends[-1] + piece.startswith(".", ends[-1]))
        # A number may not follow: what stands before it is given back, sign by sign.
        return max(e for e in ends if not piece[e : e + 1].isdecimal())


def split_notes(html: str) -> list[tuple[int, str]]:
    """(number, html) of an old page's notes: the ascending chain 1, 2, 3, ... among the places where numbers may be markers.

    At the start of a line any number may be one, alone or behind a section's number; elsewhere it needs white space and then a bracket
    or point behind it, and no point in front. Each link of the chain is the first such place after the one before.
    """
    region = _Region(html)
    places, chain, at = region.candidates(), [], (0, 0)
    while True:
        for k, start, end, opens in places.get(str(len(chain) + 1), []):
            free = opens or start == 0 or (k, start) == at or region.pieces[k][start - 1] != "."
            if free and (k, start) >= at and not (opens and (k, 0) < at):
                break
        else:
            break
        chain.append((k, start, end))
        at = (k, end)
    notes = []
    for n, (k, start, end) in enumerate(chain):
        stop = chain[n + 1] if n + 1 < len(chain) else (len(region.pieces), 0, 0)
        if stop[0] == k:
            body = region.pieces[k][end : stop[1]]
        else:
            body = region.pieces[k][end:] + "".join(region.pieces[k + 1 : stop[0]]) + "".join(region.pieces[stop[0] : stop[0] + 1])[: stop[1]]
        notes.append((n + 1, body))
    return notes


def legacy_notes(pages: DataFrame, key: str = "url", page: str = "html") -> DataFrame:
    """(key, note_seq, number, note_html) of pages whose notes stand behind the last rule, numbered from 1 upwards.

    The next marker depends on the notes found so far, so this is a function of the whole region; it runs per Arrow batch.
    """
    rows = pages.where(F.instr(page, "<hr") > 0).select(key, notes_region(F.col(page)).alias("region"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, region in enumerate(batch.column("region").to_pylist()):
                for seq, (number, note) in enumerate(split_notes(region or "")):
                    at.append(i)
                    out.append((seq, number, note))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *cols], names=[key, "note_seq", "number", "note_html"])

    return rows.mapInArrow(run, StructType([rows.schema[key], *StructType.fromDDL("note_seq int, number int, note_html string").fields]))


def choose(found: dict[str, DataFrame], key: str = "url") -> DataFrame:
    """The notes of each page by its first strategy, in the order of ``found``, that has any."""
    rows = None
    for rank, (name, df) in enumerate(found.items()):
        part = df.withColumn("strategy", F.lit(name)).withColumn("rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    best = F.min("rank").over(Window.partitionBy(key))
    return rows.withColumn("best", best).where("rank = best").drop("rank", "best")


def collect(pages: DataFrame, paragraphs: DataFrame | None = None, key: str = "url", page: str = "html") -> DataFrame:
    """(key, note_seq, number, block, note_html, strategy) of every page's notes."""
    paragraphs = paragraphs if paragraphs is not None else H.paragraphs(pages, [key], page)
    x = F.col("x")
    links = paragraphs.select(key, "block", F.explode("links").alias("x")).select(key, "block", x["seq"].alias("seq"), *[H.attribute(x["attrs"], a).alias(a) for a in ("href", "name")])
    blocks = paragraphs.select(key, "block", X.squeeze(F.col("text")).alias("text"))
    return choose(
        {
            "anchor": anchor_notes(links, key), "section": section_notes(blocks, key),
            "bracket": bracket_notes(blocks, key), "legacy": legacy_notes(pages, key, page),
        },
        key,
    )


def features(notes: DataFrame, paragraphs: DataFrame, key: str = "url") -> DataFrame:
    """(key, note_seq, number, text, links, italics, prefix) of each note, all that citations are made of.

    Notes that are paragraphs of the page are joined to them; notes cut out of a region are lexed as pages of their own. The rest is said within a paragraph.
    """
    by = [key, "note_seq", "number"]
    parts = ["text", "runs", "links", "italics"]
    cut = notes.where("note_html is not null").select(*by, F.concat(F.lit("<p>"), "note_html", F.lit("</p>")).alias("note_html"))
    # A block tag inside a cut note would end its paragraph: the whole note counts as one.
    own = H.paragraphs(cut, by, "note_html", whole=True).select(*by, *parts)
    inside = paragraphs.join(notes.where("note_html is null").select(key, "block", "note_seq", "number").hint("merge"), [key, "block"]).select(*by, *parts)
    anchors = F.transform("links", lambda x: F.struct(H.attribute(x["attrs"], "href").alias("href"), x["seq"].alias("seq"), x["before"].alias("before"), x["text"].alias("text")))
    led = lambda x: F.coalesce(U.is_document(x["href"]), F.lit(False))
    back = lambda x: x["href"].startswith("#") | x["href"].rlike(BACK)
    # By address and then by place, so that each address's first link follows no other of it.
    ordered = lambda found: X.let(F.array_sort(F.filter(found, lambda x: ~back(x))), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["href"] != F.get(s, i - 1)["href"])))
    links = lambda found: F.transform(F.array_sort(F.transform(ordered(found), lambda x: F.struct(x["seq"].alias("seq"), x["href"].alias("url"), X.squeeze(x["text"]).alias("txt")))), lambda x: F.struct(x["url"].alias("url"), x["txt"].alias("txt")))
    rows = inside.unionByName(own).withColumn("_led", F.filter(anchors, led))
    # Unlike the links, the prefix ends at any link that leads to a document, a back-link included.
    stop = F.get("_led", F.lit(0))["before"]
    prefix = F.when(stop.isNotNull(), X.squeeze(H.decode(F.array_join(F.slice("runs", F.lit(1), F.coalesce(stop, F.lit(0))), ""))))
    return rows.select(*by, X.squeeze(F.col("text")).alias("text"), links(F.col("_led")).alias("links"), F.transform("italics", lambda x: X.squeeze(x["text"])).alias("italics"), prefix.alias("prefix"))
