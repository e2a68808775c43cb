"""Reading pages and writing results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import dims
from glossa.functions import url as U
from glossa.sources.work import settle

RAW = "doc_ord int, is_source boolean, url string, html string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, html) of a folder of cached pages, one file each, named by ``cache_key``."""
    files = spark.read.text(f"{path.rstrip('/')}/*.html", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]+)\.html$", 1).alias("cache_key"), F.col("value").alias("html"))


def cached_pages(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """``urls`` (doc_ord, is_source, url) with the html of those that the cache holds."""
    return urls.withColumn("cache_key", U.cache_key(F.col("url"))).join(read_cache(spark, path), "cache_key").select("doc_ord", "is_source", "url", "html")


def missing_pages(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The ``urls`` that a fetcher still has to bring; fetching is no part of a Spark job."""
    return urls.withColumn("cache_key", U.cache_key(F.col("url"))).join(read_cache(spark, path).select("cache_key"), "cache_key", "left_anti")


def seed_pages(spark: SparkSession) -> DataFrame:
    return dims.seeds(spark).withColumn("is_source", F.lit(True)).select("doc_ord", "is_source", "url")


def write_json(df: DataFrame, path: str, by: str | None = None, compression: str = "none") -> None:
    """JSON lines without null fields, in a folder for each value of ``by``; compressed, Spark reads them as they are."""
    out = df.write.mode("overwrite").option("ignoreNullFields", "true").option("compression", compression)
    (out.partitionBy(by) if by else out).json(path)


def write_document(graph: dict[str, DataFrame], path: str) -> None:
    """The graph as one JSON text, as a page loads it: {"meta": {...}, "nodes": [...], "edges": [...]}, in a folder with one file.

    One text is written by one task, by its nature; rows stream through it in reading order and are not held.
    """
    rows = None
    for part, name in enumerate(("meta", "nodes", "edges")):
        df = graph[name]
        line = F.to_json(F.struct(*[c for c in df.columns if c != "first_seq"]))
        order = F.lpad(F.col("first_seq").cast("string"), 20, "0") if "first_seq" in df.columns else F.lit("")
        own = df.select(F.lit(part).alias("part"), order.alias("o"), line.alias("value"))
        rows = own if rows is None else rows.unionByName(own)

    def commas(batches):
        now = -1
        for batch in batches:
            out = []
            for part, value in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist(), strict=True):
                opened = ""
                while now < part:
                    now += 1
                    opened += ('{"meta":', ',"nodes":[', '],"edges":[')[now]
                out.append(opened + value if opened else "," + value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([('{"meta":{}', ',"nodes":[', '],"edges":[')[k] for k in range(now + 1, 3)] + ["]}"], pa.string())], names=["value"])

    rows.repartition(1).sortWithinPartitions("part", "o", "value").select("part", "value").mapInArrow(commas, "value string").write.mode("overwrite").text(path)


#: The parts of a graph document, as a page loads it.
DOCUMENT = {
    "meta": "documents long, in_corpus long, authors long, scripture long, edges long",
    "nodes": "id string, type string, label string, title string, author string, author_key string, doc_type string, url string, date string, cite string, book string, testament string, ord int, name string, "
    "in_corpus boolean, is_source boolean, year int, degree long, x double, y double, span struct<kind:string,start:int,end:int,label:string>, "
    "pontiff struct<ordinal:int,ordinal_label:string,display_name:string,reign_label:string,reign_start:int,reign_end:int,profile_url:string,encyclopedia_url:string>",
    "edges": "source string, target string, type string, weight long",
}


class _Elements:
    """(name, JSON) of a document's members, in order: each element of a member that is a list, the whole of another.

    Text comes in pieces; only what follows the last whole element is held. ``take`` gives what is whole so far.
    """

    BLANK = re.compile(r"[\s,:]*")

    def __init__(self) -> None:
        self.text, self.wanted, self.parse = "", 0, json.JSONDecoder().raw_decode
        self.opened = self.inside = self.closed = False
        self.name: str | None = None

    def take(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        self.text += piece
        # An element that was broken off is tried again when the text has doubled, so long ones take linear time.
        if not last and len(self.text) < self.wanted:
            return
        at = self.BLANK.match(self.text, 0).end()
        while at < len(self.text) and not self.closed:
            sign = self.text[at]
            if not self.opened:
                self.opened, at = True, self.text.index("{", at) + 1
            elif self.name is None and sign == "}":
                self.closed = True
            elif self.inside and sign == "]":
                self.inside, self.name, at = False, None, at + 1
            elif self.name is not None and not self.inside and sign == "[":
                self.inside, at = True, at + 1
            else:
                try:
                    value, end = self.parse(self.text, at)
                except json.JSONDecodeError:
                    if last:
                        raise
                    break
                if end == len(self.text) and not last:  # a number may go on
                    break
                if self.name is None:
                    self.name = value
                else:
                    yield self.name, self.text[at:end]
                    self.name = self.name if self.inside else None
                at = end
            at = self.BLANK.match(self.text, at).end()
        self.text = self.text[at:]
        self.wanted = 2 * len(self.text)
        if last and not self.closed:
            raise ValueError("a graph document that does not end")


def _elements(text: str) -> Iterator[tuple[str, str]]:
    """(name, JSON) of a whole text's members."""
    return _Elements().take(text, last=True)


def read_document(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a graph document, whoever wrote it; edges with an end that is no node are left out. Members that ``schemas`` doesn't name are passed over.

    A document is one text and is cut into its elements in one task, by its nature. Its lines stream through that task in order, which holds no more than a batch of them and
    the element at hand; elements leave it in batches and are parsed by whichever task gets them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seq = _Elements(), 0

        def rows(piece: str, last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            out: list[tuple[str, int, str]] = []
            for name, element in found.take(piece, last):
                out.append((name, seq, element))
                seq += 1
                if len(out) == 1000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

        for batch in batches:
            yield from rows("".join(f"{line}\n" for line in batch.column("value").to_pylist()))
        yield from rows("", last=True)

    schemas = schemas or DOCUMENT
    # Part files of one document are one text; its lines are numbered by file, by block of the file and as they stand there.
    place = [F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("i")]
    lines = spark.read.text(path).select(*place, "value").repartition(1).sortWithinPartitions("f", "b", "i").select("value")
    elements = settle(lines.mapInArrow(cut, "part string, seq long, value string"), "document")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda name: elements.where(F.col("part") == name).repartition(n).select(F.from_json("value", schemas[name]).alias("e"), F.col("seq").alias("first_seq"))
    out = {name: of(name).select("e.*", *(["first_seq"] if name != "meta" else [])) for name in schemas}
    ids = out["nodes"].select("id")
    for end in ("source", "target"):
        out["edges"] = out["edges"].join(ids.withColumnRenamed("id", end), end, "left_semi")
    return out


def _rows(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["part", "seq", "value"])


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """nodes, edges and meta as Parquet tables, and as JSON lines for a page to load."""
    for name, df in graph.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        write_json(df, f"{path}/{name}.json")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``write_graph``; edges with an end that is no node are left out."""
    nodes, edges = spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return {"nodes": nodes, "edges": edges, "meta": spark.read.parquet(f"{path}/meta.parquet")}
