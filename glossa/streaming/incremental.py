"""New pages as a stream: each batch is parsed and appended to the event log; sums of edges are merged at read time.

Weights are sums, so batches only append partial ones; nodes keep first values by order, so their events are kept, not their merged
state. Each batch writes a folder of its own number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import graph
from glossa.plans import build
from glossa.sources.pages import RAW


def write_batch(pages: DataFrame, batch: int, path: str) -> None:
    """The parsed tables of one batch of pages, as Parquet under ``path``/<table>/batch=<n>."""
    for name, df in build.parse(pages).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def start(spark: SparkSession, source: str, path: str, checkpoint: str, trigger: dict | None = None):
    """A streaming query over Parquet pages (doc_ord, is_source, url, html) that arrive in ``source``."""
    stream = spark.readStream.schema(RAW).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph of all batches so far."""
    tables = {n: spark.read.parquet(f"{path}/{n}").drop("batch") for n in ("documents", "citations", "scripture")}
    return build.build(tables["documents"], tables["citations"], tables["scripture"])


def edge_weights(events: DataFrame) -> DataFrame:
    """Running weights of a stream of edge events (source, target, type, n), for an update-mode sink."""
    return events.where("source <> target").groupBy("source", "target", "type").agg(F.sum("n").alias("weight"))


def merge_weights(parts: DataFrame) -> DataFrame:
    """Weights from any number of partial ones (source, target, type, weight, first_seq)."""
    return graph.merge_edges(parts.select("source", "target", "type", F.col("weight").alias("n"), F.col("first_seq").alias("seq")))
