"""Passage references in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import dims
from glossa.functions import text as X


# Fixed value: the pattern of a locator, chapters with or without verses.
LOCATOR = r"\d+(?::\d+)?(?:\s*[-–,;]\s*\d+(?::\d+)?)*"


def pattern() -> str:
    """A book token, the longest first, perhaps a point, and a locator; case counts."""
    books = "|".join(sorted((t for t, *_ in dims.abbreviations()), key=lambda t: (-len(t), t)))
    return rf"\b({books})\b\.?\s*({LOCATOR})"


def references(docs: DataFrame, key: str = "doc_key", text: str = "text", books: DataFrame | None = None) -> DataFrame:
    """(key, ref_seq, cite, book, testament, ord, locator, id) of every reference, in text order."""
    regex = F.lit("(?U)" + pattern())
    found = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(1)).alias("token"), F.regexp_extract_all(text, regex, F.lit(2)).alias("raw"))
    rows = docs.select(key, F.posexplode(found).alias("ref_seq", "m")).select(key, "ref_seq", F.col("m.token").alias("token"), X.locator(F.col("m.raw")).alias("locator"))
    # The library's own dimension has a fixed number of rows: 73 books with their abbreviations.
    rows = rows.where("locator <> ''").join(books if books is not None else F.broadcast(dims.books(docs.sparkSession)), "token")
    cite = F.concat_ws(" ", "book", "locator")
    return rows.select(key, "ref_seq", cite.alias("cite"), "book", "testament", "ord", "locator", F.concat(F.lit("scripture:"), "book", F.lit("|"), "locator").alias("id"))


def counts(refs: DataFrame, key: str = "doc_key") -> DataFrame:
    """One row per document and passage: how often, and where it first stands."""
    return refs.groupBy(key, "id", "cite", "book", "testament", "ord", "locator").agg(F.count("*").alias("cnt"), F.min("ref_seq").alias("ref_seq"))
