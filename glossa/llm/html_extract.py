"""HTML extraction: main text by markup and by a suffix array over each host's pages.

A page is lexed into tags and text; its text blocks (what stands between block-level tags) carry where they stand:
in the article or main element, in a part that is never main text (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments, scripts, styles), or undecided.

The token streams of a host's pages are concatenated, with a separator of its own after every page. Prefix doubling
gives every place its rank in the suffix array as far as its first ``REPEAT`` tokens; places that follow each other in the array
with one rank are equal substrings of that length. Substrings on enough distinct pages of the host are boilerplate, and their
places cover the tokens of every longer repeat:

* in blocks that the markup does not decide, on ``LEAST`` pages and ``SHARE`` of the host's: covered runs go, unique runs stay;
* in blocks that the markup calls main text, on ``LEAST_MAIN`` pages and ``SHARE_MAIN`` of the host's: what nearly every page of a
  host says is the host's text, whatever element holds it. Anything rarer (a quotation, a licence line) is the article's and stays.

Pages of equal text blocks are one page and count once. A host above ``SHARD_CHARS`` is cut into parts of about that size by a
hash of the page's content, so that no task holds more than some parts. The cuts do not change a result: a substring on a share of
the host's pages stands on that share of the pages of some part, so the parts name their candidates, count the candidates of
all parts, and the sums over the host decide.

Lexing takes time in proportion to the page: every pattern consumes what it has looked at, except once a page, when an attribute's
quote is never closed; from there on tags end at their first ``>``.

Defined cases: a null or empty page gives an empty text; broken markup is lexed leniently (unclosed elements end
with their parent, an unclosed comment or script runs to the page's end); a very long page is a part by itself; substrings on
equally many pages are judged alike; pages without a host share the host ''; repeated rows are extracted each; an empty table gives
an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import mix, partitions, raw, result_schema, settle, span_hashes, word_spans

REPEAT, SHARD_CHARS = 8, 4_000_000
LEAST, SHARE = 3, 0.2
LEAST_MAIN, SHARE_MAIN = 8, 0.9
GROUP = 256  # parts of a host that are told its candidates together

_WHOLE = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
_ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\"'>\s][^>\s]*+|(?=>)))*+)>"
_LEX = re.compile(rf"{_WHOLE}|{_TAG}{_ATTRIBUTES}|[^<]+|<", re.S | re.I)
_LAX = re.compile(rf"{_WHOLE}|{_TAG}([^>]*)>|[^<]+|<", re.S | re.I)
_OPENS = re.compile(r"/?[a-zA-Z]")
_REST = re.compile(r"<!--.*|[^<]+|<(?:(?!)()()()())?", re.S)  # its four groups never match
_OPEN_END = re.compile(r"<!--(?!.*-->\Z)|<(script|style|noscript|template|textarea|iframe|svg|math)\b(?!.*</\1\s*+>\Z)", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head nav footer aside form button select option dialog menu object audio video canvas".split())
_ROLE = re.compile(r"\brole\s*+=\s*+[\"']?\s*+(navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)\b", re.I)
_NAMES = re.compile(r"\b(?:class|id)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_BOX = r"(?:-?(?:box|bar|banner|block|area|section|container|wrapper|wrap|list|links|icons|buttons?|items?|slot|unit|widget|form|menu|panel|inner|top|bottom|left|right|main|primary|secondary|mobile|notice|popup|overlay|\d++))*+"
# Whole names of classes and ids, alone or with words for boxes after them: "cookie-banner", but not "social-science".
_PART = re.compile(
    rf"(?:ads?|advert(?:s|isement|ising)?|adsense|sponsor(?:s|ed)?|promo(?:s|tion|tions)?|cookies?|(?:cookie-)?consent|gdpr|notices?|alerts?|popup|modal|overlay|side-?bar|widgets?|"
    rf"nav|navbar|navigation|(?:main|top|site|sub|page|foot|footer|header)-?(?:nav|navigation|menu)|menus?|breadcrumbs?|site-?header|page-?header|site-?footer|page-?footer|footer|"
    rf"comments?|comment-?respond|replies|disqus(?:-thread)?|related(?:-(?:posts?|articles?|links?|content|stories))?|recommend(?:ed|ations?)|share|sharing|(?:social-)?share|social(?:-(?:media|links|icons))?|"
    rf"newsletter|subscribe|subscription|sign-?up|log-?in|search(?:-?form)|pagination|pager|skip-?link){{BOX}}".replace("{BOX}", _BOX),
    re.I,
)
# Names that mean the page's furniture outside the main text only.
_OUTER = re.compile(r"header|masthead|top-?bar|banner|tags|copyright|legal|search|discussion|respond", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)
_SPACE = re.compile(r"\s+")
NEVER, UNDECIDED, MAIN, ARTICLE = 0, 1, 2, 3


def _never(tag: str, attrs: str, inside: int) -> bool:
    if tag in _NEVER or (tag == "header" and inside < MAIN):
        return True
    if not attrs:
        return False
    if _ROLE.search(attrs) or _HIDDEN.search(attrs):
        return True
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").replace("_", "-").split():
            if tag not in ("body", "html", "main") and (_PART.fullmatch(name) or (inside < MAIN and tag != "article" and _OUTER.fullmatch(name))):
                return True
    return False


def lex(page: str) -> Iterator[re.Match]:
    """The tags, comments, whole elements without text, and runs of text of one page, in time linear in its length."""
    end = page.rfind(">") + 1  # no tag ends beyond
    last = None
    for m in _LEX.finditer(page, 0, end):
        if m[0] == "<" and _OPENS.match(page, m.end(), end):
            for last in _LAX.finditer(page, m.start(), end):
                yield last
            break
        yield m
        last = m
    if not (last and _OPEN_END.match(last[0])):
        yield from _REST.finditer(page, end)


def blocks(page: str) -> list[tuple[int, str]]:
    """The text blocks of one page in order: where each stands, and its text with references decoded and white space single."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    at: dict[str, list[int]] = {}  # where each open element stands in the stack
    place, parts = UNDECIDED, []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((place, text))
        parts.clear()

    def push(tag: str) -> None:
        at.setdefault(tag, []).append(len(stack))
        stack.append((tag, place))

    def pop_to(i: int) -> int:
        while len(stack) > i:
            tag, before = stack.pop()
            at[tag].pop()
        return before

    for m in lex(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                parts.append(token)
            elif m[1]:
                close() if m[1].lower() not in ("svg", "math") else None
            continue
        tag = tag.lower()
        if tag in _INLINE and not (m[4] and _never(tag, m[4], place)):
            if tag != "wbr" and not m[2]:
                push(tag)
            elif m[2] and stack and stack[-1][0] == tag:
                if stack[-1][1] != place:
                    close()
                place = pop_to(len(stack) - 1)
            continue
        close()
        if tag in _VOID:
            continue
        if m[2]:
            if at.get(tag):
                place = pop_to(at[tag][-1])
            continue
        # A block ends an open paragraph, with the inline elements left open in it; an item ends the item before it.
        ends = {"p"} | ({tag} if tag in ("li", "tr", "option") else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else set())
        i = max((x[-1] for e in ends if (x := at.get(e))), default=-1)
        if i >= 0 and all(stack[j][0] in _INLINE for j in range(len(stack) - 1, i, -1)):
            place = pop_to(i)
        if (m[4] or "").rstrip().endswith("/") and tag not in ("p", "div", "article", "main", "section"):
            continue
        push(tag)
        if place != NEVER:
            if _never(tag, m[4] or "", place):
                place = NEVER
            elif tag == "article":
                place = ARTICLE
            elif tag == "main" and place < MAIN:
                place = MAIN
    close()
    return out


def spread(start: np.ndarray) -> np.ndarray:
    """True for the REPEAT tokens from each start on."""
    n = len(start)
    level = np.zeros(n + REPEAT + 1, dtype=np.int64)
    level[:n] += start
    level[REPEAT : n + REPEAT] -= start
    return np.cumsum(level)[:n] > 0


def suffix_ranks(tokens: np.ndarray) -> np.ndarray:
    """The class of each place of a token stream in its suffix array, by prefix doubling up to REPEAT tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < REPEAT:
        step = min(width, REPEAT - width)
        after = np.full(len(rank), -1, dtype=np.int64)
        after[: max(len(rank) - step, 0)] = rank[step:]
        pair = rank * (len(rank) + 1) + after + 1
        order = np.argsort(pair, kind="stable")  # the suffix array as far as sorted
        fresh = np.append(False, pair[order][1:] != pair[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(fresh)
        width += step
    return rank


@dataclass
class Shard:
    """Pages of one host whose token streams share a suffix array."""

    ids: list = field(default_factory=list)
    urls: list = field(default_factory=list)
    places: list[bytes] = field(default_factory=list)  # a byte for each text block
    texts: list[str] = field(default_factory=list)  # text blocks, a line each

    def __post_init__(self) -> None:
        arr = pa.array([t.encode("utf-8", "surrogatepass") for t in self.texts], pa.binary())
        data, offsets = raw(arr)
        gap = (data == 32) | (data == 10)
        self.starts, self.ends = word_spans(~gap, offsets)
        self.first = np.searchsorted(self.starts, offsets)  # each page's first token
        self.words = span_hashes(data, self.starts, self.ends)
        seen: dict = {}
        self.content = np.array([seen.setdefault(t, i) for i, t in enumerate(self.texts)], dtype=np.int64)
        self.distinct = len(seen)
        self.data = data

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a run of REPEAT tokens starts within a page, and the page."""
        n = np.maximum(np.diff(self.first) - REPEAT + 1, 0)
        page = np.repeat(np.arange(len(n)), n)
        return self.first[page] + np.arange(len(page)) - np.repeat(np.cumsum(n) - n, n), page

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of the REPEAT tokens from each place on."""
        h = np.full(len(at), REPEAT, dtype=np.uint64)
        for j in range(REPEAT):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += self.words[at + j]
        return mix(h).astype(np.int64)

    def pages_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Runs, each one's class in the suffix array, on how many distinct pages each class stands; classes."""
        at, page = self.runs()
        # A separator of its own ends each page's stream.
        shift = np.repeat(np.arange(len(self.texts)), np.diff(self.first))
        stream = np.empty(len(self.words) + len(self.texts), dtype=np.int64)
        stream[np.arange(len(self.words)) + shift] = np.unique(self.words, return_inverse=True)[1]
        stream[self.first[1:] + np.arange(len(self.texts))] = -1 - np.arange(len(self.texts))
        rank = suffix_ranks(stream)[at + page]
        pair = rank * len(self.texts) + self.content[page]
        pair.sort()
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        return at, rank, np.bincount(pair // max(len(self.texts), 1), minlength=len(stream)), len(stream)

    def candidates(self) -> np.ndarray:
        """The hashes of the runs on at least SHARE of this part's pages."""
        at, rank, count, _ = self.pages_of()
        often = np.flatnonzero(count[rank] >= SHARE * self.distinct)
        return np.unique(self.hashes(at[often]))

    def counted(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted hashes ``wanted`` those of runs in this part, and on how many of its pages each stands."""
        at, page = self.runs()
        h = self.hashes(at)
        k = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
        hit = np.flatnonzero(wanted[k] == h) if len(wanted) else np.zeros(0, np.int64)
        pair = np.unique(k[hit] * len(self.texts) + self.content[page[hit]])
        k, count = np.unique(pair // max(len(self.texts), 1), return_counts=True)
        return wanted[k], count

    def boilerplate(self, told: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each token whether it is covered by common runs: by the rule for undecided blocks, and by that for main text.

        ``told`` are sorted hashes of the host's common runs, their pages, and the host's distinct pages; without it the part is the host.
        """
        if told is None:
            at, rank, count, _ = self.pages_of()
            pages, contents = count[rank], self.distinct
        else:
            at, _ = self.runs()
            h, contents = self.hashes(at), told[2]
            k = np.minimum(np.searchsorted(told[0], h), max(len(told[0]) - 1, 0))
            pages = np.where(told[0][k] == h, told[1][k], 0) if len(told[0]) else np.zeros(len(at), np.int64)
        out = []
        for least, share in ((LEAST, SHARE), (LEAST_MAIN, SHARE_MAIN)):
            start = np.zeros(len(self.words), dtype=bool)
            start[at[pages >= max(least, share * contents)]] = True
            out.append(spread(start))
        return out[0], out[1]

    def extract(self, told: tuple[np.ndarray, np.ndarray, int] | None = None) -> Iterator[tuple]:
        """Page id, url, main text, tokens covered by the host's repeats."""
        common, nearly_all = self.boilerplate(told)
        for i, (page, url, places, text) in enumerate(zip(self.ids, self.urls, self.places, self.texts, strict=True)):
            at, kept = int(self.first[i]), []
            repeats = int(common[at : self.first[i + 1]].sum())
            marked = max(places, default=UNDECIDED) >= MAIN
            for place, block in zip(places, text.split("\n"), strict=False):
                n = block.count(" ") + 1
                cover = (nearly_all if marked else common)[at : at + n]
                at += n
                if place == NEVER or (marked and place < MAIN):
                    continue
                if not cover.any():
                    kept.append(block)
                elif not cover.all():
                    kept.append(" ".join(w for w, c in zip(block.split(" "), cover, strict=True) if not c))
            yield page, url, " ".join(kept), repeats


def host_of(url):
    """The lower-cased host of a URL column; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text, n_chars (code points), n_repeated (tokens in runs common on the host)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    sizes = rows.groupBy("_host").agg(F.sum(F.octet_length("_html") + 1).alias("b"))
    all_hosts = sizes.agg(F.sum("b").alias("total"), F.max("b").alias("most")).first()
    total, most = all_hosts["total"] or 0, all_hosts["most"] or 0
    n = max(partitions(spark), -(-total // SHARD_CHARS))
    large = sizes.where(F.col("b") > SHARD_CHARS).select("_host", F.ceil(F.col("b") / SHARD_CHARS).cast("int").alias("_cuts"))
    # So many hosts at most are large; a longer list is joined by a shuffle.
    rows = rows.join(F.broadcast(large) if total / SHARD_CHARS < 50_000 else large, "_host", "left")
    rows = rows.select("_host", F.coalesce("_cuts", F.lit(1)).alias("_cuts"), "_id", "_url", "_html")
    kept = rows.drop("_html").schema

    def lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, places, texts = [], [], []
            for cuts, text in zip(batch.column("_cuts").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                found = blocks(text)
                texts.append("\n".join(t for _, t in found))  # white space within a block is single blanks
                places.append(bytes(p for p, _ in found))
                cut.append(zlib.crc32(texts[-1].encode("utf-8", "surrogatepass")) % cuts)
            cols = [*(batch.column(c) for c in kept.names), pa.array(cut, pa.int32()), pa.array(places, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept.names, "_cut", "_places", "_texts"])

    def shard_of(table: pa.Table) -> Shard:
        return Shard(*(table.column(c).to_pylist() for c in ("_id", "_url", "_places", "_texts")))

    def listed(table: pa.Table, *more: pa.Array) -> pa.Table:
        head = table.slice(0, 1).select(["_host", "_cut", "_cuts"])
        names = ["_host", "_cut", "_cuts", "_contents", "_runs", "_pages"]
        return pa.Table.from_arrays([*(c.combine_chunks() for c in head.columns), *more], names=names) if table.num_rows else pa.table({k: [] for k in names}, schema=notes)

    def name(table: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("_cuts")[0].as_py() == 1:
            return pa.Table.from_pylist([], schema=notes)
        shard = shard_of(table)
        return listed(table, pa.array([shard.distinct]), pa.array([shard.candidates()], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int64())))

    def count(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return pa.Table.from_pylist([], schema=notes)
        shard = shard_of(table)
        runs, pages_ = shard.counted(np.sort(told.column("_runs").combine_chunks().values.to_numpy()))
        return listed(table, pa.array([shard.distinct]), pa.array([runs], pa.list_(pa.int64())), pa.array([pages_], pa.list_(pa.int64())))

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        known = None
        if table.num_rows and table.column("_cuts")[0].as_py() > 1:
            known = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
            if told.num_rows:
                runs, pages_ = (told.column(c).combine_chunks().values.to_numpy() for c in ("_runs", "_pages"))
                order = np.argsort(runs)
                known = runs[order], pages_[order], told.column("_contents")[0].as_py()
        out = list(shard_of(table).extract(known)) if table.num_rows else []
        cols = [pa.array([x[0] for x in out], table.schema.field("_id").type), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
        return pa.Table.from_arrays([*cols, pa.array([len(x[2]) for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64())], names=["_id", "_url", "text", "n_chars", "n_repeated"])

    notes = pa.schema([("_host", pa.string()), ("_cut", pa.int32()), ("_cuts", pa.int32()), ("_contents", pa.int64()), ("_runs", pa.list_(pa.int64())), ("_pages", pa.list_(pa.int64()))])
    noted = "_host string, _cut int, _cuts int, _contents long, _runs array<long>, _pages array<long>"
    schema = result_schema(rows.select("_id", "_url").schema, "text string, n_chars long, n_repeated long")
    # All passes over the pages read one exchange.
    dealt = rows.mapInArrow(lexed, result_schema(kept, "_cut int, _places binary, _texts string")).repartition(n, "_host", "_cut")
    shards = dealt.groupBy("_host", "_cut")
    if most <= SHARD_CHARS:
        done = shards.applyInArrow(lambda table: finish(table, table.slice(0, 0)), schema)
    else:
        named = settle(shards.applyInArrow(name, noted), "html-candidates")
        hosts = named.groupBy("_host").agg(F.sum("_contents").alias("_contents"), F.max("_cuts").alias("_cuts"))
        runs = named.select("_host", F.explode("_runs").alias("_run")).distinct()
        counted = settle(shards.cogroup(_tell(runs.withColumn("_page", F.lit(0).cast("long")), hosts).groupBy("_host", "_cut")).applyInArrow(count, noted), "html-counts")
        pairs = counted.select("_host", F.explode(F.arrays_zip("_runs", "_pages")).alias("p")).groupBy("_host", F.col("p._runs").alias("_run")).agg(F.sum("p._pages").alias("_page"))
        common = pairs.join(hosts.select("_host", "_contents"), "_host").where((F.col("_page") >= LEAST) & (F.col("_page") >= SHARE * F.col("_contents"))).drop("_contents")
        done = shards.cogroup(_tell(common, hosts).groupBy("_host", "_cut")).applyInArrow(finish, schema)
    return done.withColumnsRenamed({"_id": id_col, "_url": url_col})


def _tell(runs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(_host, _cut, _contents, _runs, _pages): what each part of a large host is told, from ``runs`` (_host, _run, _page).

    A host's list is packed once for GROUP parts, so no row meets all parts of a host in one task.
    """
    groups = hosts.withColumn("_group", F.explode(F.expr(f"sequence(0, (_cuts - 1) div {GROUP})")))
    lists = runs.join(groups, "_host").groupBy("_host", "_group").agg(
        F.first("_contents").alias("_contents"), F.first("_cuts").alias("_cuts"), F.collect_list(F.struct("_run", "_page")).alias("_list")
    )
    cuts = F.expr(f"sequence(cast(_group * {GROUP} as int), cast(least(_cuts, (_group + 1) * {GROUP}) - 1 as int))")
    return lists.select("_host", F.explode(cuts).alias("_cut"), "_contents", F.col("_list._run").alias("_runs"), F.col("_list._page").alias("_pages"))
