"""Best-fit packing under conflicts.

Documents become sequences of at most ``capacity`` tokens (words apart by ASCII white space, plus one for the end of the text). A
longer document first fills sequences of its own; its rest is packed like any other. Items are dealt at random to shards of
about ``SHARD`` items and packed there by decreasing size: a shard's open bins are kept in order of their residual space, each with
one bitmap of its sources and one of its duplicate clusters. The search starts at the successor of the item's size and goes on, through
ever larger residuals, until the tightest bin that shares neither source nor cluster with the item; if there is none, a bin is opened.

Clusters are given by a column, or are the texts equal after lower-casing A-Z. Only ids and sizes are dealt, never texts, so a shard is a few
hundred kilobytes whatever its documents. Defined cases: a null or empty text is an item of size 1; a null source or cluster
conflicts with nothing; repeated rows are items each (of one cluster); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glossa.llm.common import ascii_lower, lower_bytes, partitions, raw, settle, string_blocks, word_spans
from glossa.llm.common import _SPACE as _IS_SPACE

CAPACITY, SHARD, STEP = 2048, 4096, 64


class Bins:
    """Open bins in order of residual space."""

    def __init__(self, items: int, sources: int, clusters: int):
        self.residual = np.zeros(items, dtype=np.int64)  # in order
        self.bin = np.zeros(items, dtype=np.int64)  # the bin at each place
        self.sources = np.zeros((items, sources // 64 + 1), dtype=np.uint64)
        self.clusters = np.zeros((items, clusters // 64 + 1), dtype=np.uint64)
        self.open, self.made = 0, 0

    def place(self, size: int, capacity: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of an item; source and cluster are numbers within the shard, -1 for none."""
        at = self._find(size, source, cluster)
        if at < 0:
            b, left, at = self.made, capacity, self.open
            self.made, self.open = self.made + 1, self.open + 1
        else:
            b, left = int(self.bin[at]), int(self.residual[at])
        rest = left - size
        to = int(np.searchsorted(self.residual[:at], rest))
        self.residual[to + 1 : at + 1] = self.residual[to:at].copy()
        self.bin[to + 1 : at + 1] = self.bin[to:at].copy()
        self.residual[to], self.bin[to] = rest, b
        for bits, k in ((self.sources, source), (self.clusters, cluster)):
            if k >= 0:
                bits[b, k >> 6] |= np.uint64(1 << (k & 63))
        return b, capacity - left

    def _find(self, size: int, source: int, cluster: int) -> int:
        p = int(np.searchsorted(self.residual[: self.open], size))
        while p < self.open:
            bins = self.bin[p : min(p + STEP, self.open)]
            clash = np.zeros(len(bins), dtype=np.uint64)
            for bits, k in ((self.sources, source), (self.clusters, cluster)):
                if k >= 0:
                    clash |= bits[bins, k >> 6] & np.uint64(1 << (k & 63))
            free = np.flatnonzero(clash == 0)
            if len(free):
                return p + int(free[0])
            p += len(bins)
        return -1


def _numbers(values: list, least: int) -> tuple[list[int], int]:
    """A number for each distinct non-null value held by at least ``least`` items; -1 for the others."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    known: dict = {}
    return [known.setdefault(v, len(known)) if v is not None and count[v] >= least else -1 for v in values], len(known)


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item, in the given order (largest first for the usual guarantee)."""
    source, ns = _numbers(sources, 1)
    cluster, nc = _numbers(clusters, 2)
    bins = Bins(len(sizes), ns, nc)
    return [bins.place(*x) for x in zip(sizes, [capacity] * len(sizes), source, cluster, strict=True)]


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None) -> DataFrame:
    """(row, id, size, source, cluster) of each document, written: ``row`` is a fixed number of the row."""
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(ascii_lower(F.col(text_col)))
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), source.alias("source"), cluster.alias("cluster"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.ones(batch.num_rows, dtype=np.int64)
            for a, b, arr in string_blocks(batch, "_text"):
                data, offsets = raw(arr)
                starts, _ = word_spans(~_IS_SPACE[lower_bytes(data)], offsets)
                sizes[a:b] += np.diff(np.searchsorted(starts, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), batch.column("source"), batch.column("cluster")], names=["_id", "size", "source", "cluster"])

    fields = [StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL("size long, source string, cluster string").fields]
    return settle(base.mapInArrow(run, StructType(fields)).withColumn("row", F.monotonically_increasing_id()), "packing-items")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster_col: str | None = None, shard: int = SHARD
) -> DataFrame:
    """One row per piece of a document: ``id_col``, piece (from 0), n_tokens, bin_id, position (tokens before it in its bin), source, cluster."""
    found = items(docs, id_col, text_col, source_col, cluster_col)
    shards = max(1, -(-found.count() // shard))
    rest = F.when(F.col("size") > capacity, F.pmod("size", F.lit(capacity))).otherwise(F.col("size"))
    dealt = found.select("_id", "size", "source", "cluster", rest.alias("rest"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row")
    dealt = dealt.repartition(min(shards, partitions(docs.sparkSession)), "shard").sortWithinPartitions("shard", F.desc("rest"), F.desc("size"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, id_type = None, [], pa.int64()

        def finish(number: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            loose = [r for r in rows if r[4]]
            spots = pack_shard([r[4] for r in loose], [r[2] for r in loose], [r[3] for r in loose], capacity)
            made = max((b for b, _ in spots), default=-1) + 1
            out: list[tuple] = []
            where = {r[5]: s for r, s in zip(loose, spots, strict=True)}
            for i, size, source, cluster, rest, row in rows:
                whole = (size - rest) // capacity
                for piece in range(whole):
                    out.append((i, piece, capacity, (number << 32) + made, 0, source, cluster))
                    made += 1
                if rest:
                    b, at = where[row]
                    out.append((i, whole, rest, (number << 32) + b, at, source, cluster))
                if len(out) > 20_000:
                    yield rows_of(out)
                    out = []
            yield rows_of(out)

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["_id", "piece", "n_tokens", "bin_id", "position", "source", "cluster"])

        for batch in batches:
            id_type = batch.schema.field("_id").type
            for now, *item in zip(*(batch.column(c).to_pylist() for c in ("shard", "_id", "size", "source", "cluster", "rest", "row")), strict=True):
                if now != key:
                    if group:
                        yield from finish(key, group)
                    key, group = now, []
                group.append(tuple(item))
        if group:
            yield from finish(key, group)

    fields = [StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL("piece long, n_tokens long, bin_id long, position long, source string, cluster string").fields]
    return dealt.mapInArrow(run, StructType(fields)).withColumnRenamed("_id", id_col)
