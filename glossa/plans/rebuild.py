"""A store of parsed pages that is brought up to date: only pages that are new or have changed are parsed.

Each update is a version. It writes, under ``store``/<table>/version=<n>:

* ``documents``, ``citations``, ``scripture`` - the parsed rows of the pages it parsed, with the page's address;
* ``sums`` - what these pages add to each edge, and with a minus sign what their former versions and the pages that went had added;
* ``pages`` - which pages came, changed or went, with the digest of their content. It is written last and makes the version count: rows of a table
  are live if the log's last entry of their page names their version, so a broken-off update leaves nothing behind that is read, and
  running it again replaces it.

Edge weights are sums of ``sums`` over all versions and need no event again. A citation without a link stands in ``sums`` under its title; which node that is
depends on all live documents, so it is settled when edges are read. First values (node fields, title index) are no sums: they
are taken from the live rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import graph
from glossa.plans import build
from glossa.sources.work import settle

PAGES = "url string, doc_ord long, is_source boolean, digest string, live boolean, version int"
TABLES = ("documents", "citations", "scripture")
SUMS = ["kind", "source", "target", "norm_title", "linked", "author_key"]


def _log(spark: SparkSession, store: str) -> DataFrame:
    """The log's entries; none where nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/pages")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], PAGES)
    return spark.read.schema(PAGES).parquet(f"{store}/pages")


def state(spark: SparkSession, store: str) -> DataFrame:
    """(url, doc_ord, is_source, digest, version) of the pages that are live."""
    entry = F.struct("version", "doc_ord", "is_source", "digest", "live")
    last = _log(spark, store).groupBy("url").agg(F.max_by(entry, "version").alias("e"))
    return last.where("e.live").select("url", "e.doc_ord", "e.is_source", "e.digest", "e.version")


def latest(spark: SparkSession, store: str) -> int:
    """The last version that counts; -1 without any."""
    return _log(spark, store).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]


def live(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of a table that count now, with their page's ``_url``."""
    now = state(spark, store).select(F.col("url").alias("_url"), "version").hint("merge")
    return spark.read.option("mergeSchema", "false").parquet(f"{store}/{table}").join(now, ["_url", "version"]).drop("version")


def sums(documents: DataFrame, citations: DataFrame, scripture: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, source, target, norm_title, linked, author_key, n): what documents add to edges, before titles are settled."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, target: Column, norm_title: Column, linked: Column, author_key: Column, n: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("doc_key").alias("source"), target.alias("target"), norm_title.alias("norm_title"), linked.alias("linked"), author_key.alias("author_key"), n.cast("long").alias("n"))

    own = rows(documents.where(graph.given("author_key")), "author", none, none, F.lit(True), F.col("author_key"), F.lit(sign))
    url = F.coalesce(F.col("url"), F.lit("")) != ""
    cites = rows(citations, "cite", F.col("target_key"), X.norm_title(F.col("title")), url, F.nullif("author_key", F.lit("")), F.lit(sign))
    passages = rows(scripture, "passage", F.col("id"), none, F.lit(True), none, F.col("cnt") * sign)
    return own.unionByName(cites).unionByName(passages).groupBy(*SUMS).agg(F.sum("n").alias("n")).where("n <> 0")


def update(spark: SparkSession, store: str, pages: DataFrame, whole: bool = True) -> dict[str, int]:
    """Bring ``store`` up to date with ``pages`` (doc_ord, is_source, url, html) and return version, parsed, kept and gone.

    Pages of the same address, content and place stay as they are. With ``whole`` pages that are stored and not in ``pages`` go. Pages that cannot be
    parsed are left out as in ``build.build_graph``; one address may stand in ``pages`` once.
    """
    version = latest(spark, store) + 1
    # Whoever parses a page anew needs its text: the digests alone are compared, and texts are joined to what has changed.
    good = pages.where(~build.bad())
    now = settle(good.select("url", F.col("doc_ord").cast("long").alias("doc_ord"), "is_source", F.sha2("html", 256).alias("digest")), "digests")
    before = settle(state(spark, store), "page-state").hint("merge")
    same = [now[c].eqNullSafe(before[c]) for c in ("url", "doc_ord", "is_source", "digest")]
    fresh = settle(now.join(before, same[0] & same[1] & same[2] & same[3], "left_anti"), "pages-fresh")
    now = now.hint("merge")
    gone = before.join(now, "url", "left_anti") if whole else before.where("false")
    changed = settle(before.join(fresh.select("url").hint("merge"), "url", "left_semi").unionByName(gone).select(F.col("url").alias("_url"), "version"), "pages-changed")
    counts = {"version": version, "parsed": fresh.count(), "gone": gone.count()}
    counts["kept"] = now.count() - counts["parsed"]
    if not counts["parsed"] and not counts["gone"]:
        return counts | {"version": version - 1}
    # A parse reads its pages several times; they are made once.
    parsed = build.parse(settle(good.join(fresh.select("url").hint("merge"), "url", "left_semi"), "pages-parsed"))
    address = parsed["documents"].select("doc_ord", F.col("source_url").alias("_url")).hint("merge")
    written = {}
    for name in TABLES:
        path = f"{store}/{name}/version={version}"
        parsed[name].join(address, "doc_ord").write.mode("overwrite").parquet(path)
        written[name] = spark.read.parquet(path)
    total = sums(*(written[name] for name in TABLES))
    if version and not changed.isEmpty():
        old = {name: spark.read.parquet(f"{store}/{name}").join(changed.hint("merge"), ["_url", "version"]) for name in TABLES}
        total = total.unionByName(sums(*(old[name] for name in TABLES), sign=-1)).groupBy(*SUMS).agg(F.sum("n").alias("n")).where("n <> 0")
    total.write.mode("overwrite").parquet(f"{store}/sums/version={version}")
    entries = fresh.withColumn("live", F.lit(True)).unionByName(gone.drop("version").withColumn("live", F.lit(False)))
    entries.write.mode("overwrite").parquet(f"{store}/pages/version={version}")
    return counts


def edges(spark: SparkSession, store: str) -> DataFrame:
    """(source, target, type, weight) of the graph, from the sums of all versions that count."""
    rows = spark.read.parquet(f"{store}/sums").where(F.col("version") <= latest(spark, store)).groupBy(*SUMS).agg(F.sum("n").alias("n")).where("n <> 0")
    index = graph.title_index(live(spark, store, "documents"), live(spark, store, "citations"))
    person = F.concat(F.lit("author:"), "author_key")
    cites = graph.canonical_by_title(rows.where("kind = 'cite'").withColumnRenamed("target", "target_key"), index, F.col("linked")).withColumnRenamed("target_key", "target")
    edge = lambda df, source, target, kind: df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), "n")
    every = (
        edge(rows.where("kind = 'author'"), F.col("source"), person, "authored_by").unionByName(edge(cites, F.col("source"), F.col("target"), "cites"))
        .unionByName(edge(cites.where("author_key is not null"), F.col("target"), person, "authored_by")).unionByName(edge(rows.where("kind = 'passage'"), F.col("source"), F.col("target"), "cites_scripture"))
    )
    return every.where("source <> target").groupBy("source", "target", "type").agg(F.sum("n").alias("weight"))


def tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """documents, citations and scripture as one parse of all live pages would give them."""
    return {name: live(spark, store, name).drop("_url") for name in TABLES}


def graph_of(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """nodes, edges and meta of all live pages."""
    return build.build(**{f"{n}_" if n != "citations" else n: df for n, df in tables(spark, store).items()})
