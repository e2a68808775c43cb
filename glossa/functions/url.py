"""URL functions: Column to Column, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa import dims


def cache_key(url: Column) -> Column:
    """The first 16 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def alias_host(url: Column) -> Column:
    """https everywhere, and the main host in place of its alias."""
    return F.replace(F.replace(url, F.lit("http://"), F.lit("https://")), F.lit("https://w2.vatican.va"), F.lit("https://www.vatican.va"))


def host(url: Column) -> Column:
    """What stands between // and the path; empty for relative URLs."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path: without scheme, host, query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def is_document(url: Column) -> Column:
    """Whether a link leads to a document page of the corpus's site; relative links count, null and empty don't."""
    h, p = host(url), F.lower(path(url))
    ours = (h == "") | F.contains(h, F.lit("vatican.va"))
    kind = p.contains("/documents/") | p.contains("/archive/") | p.contains("_enc_")
    return F.coalesce((url != "") & ours & p.rlike(r"\.html?$") & kind, F.lit(False))


def doc_key(url: Column) -> Column:
    """A key of the document that doesn't depend on language, host, folder or fragment."""
    p = path(url)
    stem = F.substring_index(p, "/", -1)
    stem = F.regexp_replace(stem, r"\.(html?|HTML?)$", "")
    stem = F.regexp_replace(stem, f"(?i)_({dims.LANGUAGES})$", "")
    stem = F.regexp_replace(stem, "(?i)(vat-ii)_cons_", "$1_const_")
    return F.when(p.contains("/archive/ENG0015/"), "doc:catechism-of-the-catholic-church").otherwise(F.concat(F.lit("doc:"), F.lower(stem)))


def slug_title(key: Column) -> Column:
    """A display title from a document key: the words after its last date, capitalised; the stem where there are none."""
    stem = F.regexp_replace(key, "^doc:", "")
    tail = F.regexp_replace(F.concat(F.lit("_"), stem), r"^.*_[0-9]{6,8}(?=_|$)", "")
    words = F.filter(F.split(F.regexp_replace(tail, "[-_\\s]+", " "), " "), lambda w: w != "")
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    return F.when(F.size(words) > 0, F.array_join(capital, " ")).otherwise(stem)


def resolve(base: Column, url: Column) -> Column:
    """``url`` as seen from the page ``base``: absolute, scheme-relative, rooted, fragment or query only, or beside the page (with dots)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    parts = F.split(F.concat(folder, F.regexp_extract(url, "^([^?#]*)", 1)), "/")
    tidy = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    slash = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    beside = F.concat(origin, F.array_join(tidy, "/"), slash, F.regexp_extract(url, "^[^?#]*(.*)$", 1))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", url)
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url == "", base)
        .when(url.startswith("#"), F.concat(strip_fragment(base), url))
        .when(url.startswith("?"), F.concat(origin, path(base), url))
        .otherwise(beside)
    )


def is_layer2(url: Column) -> Column:
    """Whether a cited URL is worth parsing as the second layer."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    first = F.try_element_at(parts, F.lit(1))
    at = F.array_position(parts, F.lit("documents"))
    kind = F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int"))).otherwise(F.element_at(parts, -1))
    good = F.when((first == "archive") & F.array_contains(parts, "ENG0015"), False).when(first.isin("roman_curia", "archive") & (at > 0), True)
    return F.coalesce(F.contains(host(url), F.lit("vatican.va")) & (F.size(parts) > 0) & good.when(at > 0, kind.isin(dims.LAYER2_KINDS)).otherwise(False), F.lit(False))


def pope_name(slug: Column) -> Column:
    """A pope's name from a URL slug: roman numerals in capitals, other parts capitalised."""
    part = lambda s: F.when(s.rlike("(?i)^[ivxlcdm]+$"), F.upper(s)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20))))
    out = F.array_join(F.transform(F.split(slug, "-"), part), " ")
    for known, name in dims.POPE_SLUGS.items():
        out = F.when(slug == known, name).otherwise(out)
    return out


def body_slug(url: Column) -> Column:
    """The slug of the issuing body in a URL; null where there is none."""
    a = F.regexp_extract(url, "(?i)/roman_curia/[^/]+/([^/]+)/", 1)
    b = F.regexp_extract(url, "(?i)/archive/hist_councils/([^/]+)/", 1)
    return F.lower(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def file_date(url: Column) -> Column:
    """The YYYYMMDD between underscores in a URL; null where there is none."""
    return F.nullif(F.regexp_extract(url, "_([0-9]{8})_", 1), F.lit(""))


def author_slug(url: Column) -> Column:
    a = F.regexp_extract(url, "/content/([^/]+)/", 1)
    b = F.regexp_extract(url, "/([a-z-]+)/[a-z_]+/documents/", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("unknown"))


def permalink(view: Column, ids: Column, x: Column, y: Column, scale: Column) -> Column:
    """The address fragment of a view: its name unless it is the first view's, the selected ids percent-encoded, and the camera."""
    coded = lambda i: F.replace(F.url_encode(i), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = (lambda f, code, mark: lambda i: F.replace(f(i), F.lit(code), F.lit(mark)))(coded, code, mark)
    shown = F.when(view != "explore", F.concat(F.lit("view="), view))
    chosen = F.when(F.size(ids) > 0, F.concat(F.lit("sel="), F.array_join(F.transform(ids, coded), ",")))
    return F.concat(F.lit("#"), F.concat_ws("&", shown, chosen, F.format_string("cam=%.1f,%.1f,%.3f", x + F.lit(0.0), y + F.lit(0.0), scale)))


def permalink_part(link: Column, name: str) -> Column:
    """The value of ``name`` (view, sel or cam) in a permalink; null where it is missing."""
    return F.nullif(F.regexp_extract(link, f"[#&]{name}=([^&]*)", 1), F.lit(""))


def permalink_ids(link: Column) -> Column:
    """The selected ids of a permalink, decoded after cutting."""
    s = permalink_part(link, "sel")
    return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(s, ","), lambda i: F.url_decode(i)))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
