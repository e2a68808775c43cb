"""Connected components of a graph given as rows of links, by alternating star contractions.

Each round points every node's larger neighbours, then its smaller ones, at the least neighbour; the links end as stars
whose centres are the components' least nodes. A round is two aggregations with map-side partial minima and two joins, and is
written to the shared folder; what the round before wrote goes. Links of hubs (nodes of more than HUB links, and of more than a
MOST_HUBS-th of all, so there are few) meet their least neighbour by a broadcast of the hubs, where they stand: no star, however
large, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import forget, partitions, settle

HUB, MOST_HUBS = 100_000, 10_000


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _few(df: DataFrame, links: int) -> DataFrame:
    """``df`` in as many tasks as ``links`` rows are worth: the graph shrinks while it is contracted."""
    return df.coalesce(min(partitions(df.sparkSession), max(4, -(-links // 50_000))))


def _with_least(rows: DataFrame, links: int) -> DataFrame:
    """``rows`` (u, v) with m, the least v of each u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    if links <= HUB:
        return rows.join(least.drop("k"), "u")
    hub = max(HUB, links // MOST_HUBS)  # rows count either way, so at most 2 * MOST_HUBS nodes are hubs
    hubs = settle(least.where(F.col("k") > hub).drop("k"), "hubs")
    if hubs.isEmpty():
        return rows.join(least.drop("k"), "u")
    calm = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    calm = calm.join(calm.groupBy("u").agg(F.min("v").alias("m")), "u")
    return calm.unionByName(rows.join(F.broadcast(hubs), "u"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of ``links`` (u, v: long) the least node that it can reach. Loops and repeats are harmless."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = settle(pairs, "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both, mark[0]).withColumn("m", F.least("u", "m"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(_few(large, mark[0]), "links")
        small = _with_least(large, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        before, pairs = pairs, settle(_few(small.unionByName(least).distinct(), mark[0]), "links")
        now = _mark(pairs)
        forget(before, large)
        if now == mark:
            break
        mark = now
    own = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own)
