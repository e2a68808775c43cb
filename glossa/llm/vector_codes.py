"""Vector code compression: product codes of integer vectors, codebooks refined by rounds of nearest entry and whole-number means.

Components become floor(4096 * x); vectors are cut into ``PARTS`` equal parts and each part position has a codebook of up to ``ENTRIES`` entries, at first
that part of the vectors of the smallest ids. Every round

1. the driver builds a kd-tree over each codebook (``Tree``; some hundred small arrays, whatever the table's size) and sends them with the tasks;
2. tasks search the trees for all parts of a batch at once, branch and bound: a batch goes down both sides of a node, and the side away from a part is visited
   if the node's plane is no farther than the best entry so far - also if it is just as far, since an entry of equal distance and lower index may lie
   there and wins;
3. tasks add up the components and the number of parts of each entry; these sums, one row a task and codebook entry at most, are added by an aggregation, and the
   driver gets one row an entry and takes floor(sum / count). Unused entries stay.

All arithmetic is on 64-bit integers, so neither the order of rows nor of tasks can change a result. The label sums of errors are an aggregation joined back, so no
label's rows meet in one task.

Defined cases: a null vector and one with a null or non-finite component are dropped, and so are vectors whose length is no positive multiple of
``PARTS`` or not that of the kept vector of the smallest id (ties: the shorter); with fewer than ``ENTRIES`` vectors there are as many entries; rows of one id count each,
ordered by their components for the first entries, and null ids come last; equal entries: the lower index wins; an empty table gives an empty result;
components beyond +-``LIMIT`` after scaling would overflow the sums of squares and stop the job with that message; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glossa.llm.common import forget, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 2
LIMIT = 1 << 26
ROWS = 1 << 14  # vectors searched at a time


@dataclass
class Tree:
    """A kd-tree over a codebook's entries: a leaf holds entry numbers in ascending order, a node a dimension, a plane and two sides."""

    entries: np.ndarray
    members: np.ndarray | None = None
    dim: int = 0
    plane: int = 0
    below: Tree | None = None
    above: Tree | None = None

    @classmethod
    def build(cls, entries: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF) -> Tree:
        members = np.arange(len(entries)) if members is None else members
        held = entries[members]
        spread = held.max(axis=0) - held.min(axis=0) if len(members) else np.zeros(1)
        dim = int(spread.argmax())
        if len(members) <= leaf or not spread[dim]:
            return cls(entries, members)
        values = np.unique(held[:, dim])
        plane = int(values[(len(values) - 1) // 2])  # entries up to the plane lie below it
        side = held[:, dim] <= plane
        return cls(entries, None, dim, plane, cls.build(entries, members[side], leaf), cls.build(entries, members[~side], leaf))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point and the squared distance; of equally near ones the lowest index."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries), dtype=np.int64)
        self._visit(points, np.arange(len(points)), best, index)
        return index, best

    def _visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if self.members is not None:
            for e in self.members:
                far = points[rows] - self.entries[e]
                far = np.einsum("ij,ij->i", far, far)
                won = (far < best[rows]) | ((far == best[rows]) & (e < index[rows]))
                best[rows[won]], index[rows[won]] = far[won], e
            return
        gap = points[rows, self.dim] - self.plane
        low = gap <= 0
        # The side above holds values of plane + 1 and more.
        bound = np.where(low, gap - 1, gap) ** 2
        self.below._visit(points, rows[low], best, index)
        self.above._visit(points, rows[~low], best, index)
        again = bound <= best[rows]
        self.above._visit(points, rows[low & again], best, index)
        self.below._visit(points, rows[~low & again], best, index)


def _integers(batch: pa.RecordBatch, column: str, parts: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that may be kept: their places, their lengths, where each starts, and all their components as integers one after the other."""
    lists = batch.column(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (size > 0) & (size % parts == 0) & (bad[start + size] == bad[start])
    kept = np.flatnonzero(good)
    whole = np.floor(values[np.repeat(good, size)] * scale)
    if len(whole) and np.abs(whole).max() > limit:
        raise ValueError(f"vector components over {limit / scale:g} can't be coded: sums of squares would overflow")
    return kept, size[kept], np.cumsum(size[kept]) - size[kept], whole.astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(_id, _label, dims int, v binary): the kept rows, components as little-endian 32-bit integers."""
    base = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    schema = StructType([*base.schema.fields[:2], *StructType.fromDDL("dims int, v binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, start, whole = _integers(batch, "_v", parts, scale, LIMIT)
            packed = whole.astype("<i4").tobytes()
            v = [packed[4 * p : 4 * (p + n)] for p, n in zip(start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(kept)), batch.column("_label").take(pa.array(kept)), pa.array(size, pa.int32()), pa.array(v, pa.binary())], names=["_id", "_label", "dims", "v"])

    return base.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of a batch with their vectors as a matrix."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.column("v").slice(at, ROWS)
        yield at, len(part), np.frombuffer(b"".join(part.to_pylist()), dtype="<i4").astype(np.int64).reshape(len(part), dims)


def first_entries(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, dims / parts): the parts of the vectors of the smallest ids, in order of ids; a top-k of ``entries`` rows."""
    order = [F.col("_id").asc_nulls_last(), F.col("dims"), F.col("v")]
    lead = kept.orderBy(*order).select("dims").first()
    if lead is None:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    rows = kept.where(F.col("dims") == lead["dims"]).orderBy(*order).select("v").limit(entries).collect()
    return np.stack([np.frombuffer(bytes(r["v"]), dtype="<i4").astype(np.int64).reshape(parts, -1) for r in rows], axis=1)


def refine(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to its parts' means, rounded down."""
    parts, entries, width = codebooks.shape
    trees = [Tree.build(c) for c in codebooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, n, matrix in _blocks(batch, parts * width):
                for p, tree in enumerate(trees):
                    points = matrix[:, p * width : (p + 1) * width]
                    index, _ = tree.nearest(points)
                    count[p] += np.bincount(index, minlength=entries)
                    np.add.at(total[p], index, points)
        used = np.argwhere(count > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(count[tuple(used.T)]), pa.array(list(total[tuple(used.T)]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
        )

    sums = kept.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total"))
    out = codebooks.copy()
    for r in sums.collect():  # at most one row an entry of a codebook
        out[r["part"], r["entry"]] = [x // r["n"] for x in r["total"]]
    return out


def assign(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(_id, _label, code, error) of all kept rows."""
    parts, _, width = codebooks.shape
    trees = [Tree.build(c) for c in codebooks]
    schema = StructType([*kept.schema.fields[:2], *StructType.fromDDL("code string, error long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, matrix in _blocks(batch, parts * width):
                codes, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, tree in enumerate(trees):
                    index, far = tree.nearest(matrix[:, p * width : (p + 1) * width])
                    codes[:, p] = index
                    error += far
                text = [bytes(c).hex() for c in codes]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, n), batch.column("_label").slice(at, n), pa.array(text, pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"])

    return kept.select("_id", "_label", "v").mapInArrow(run, schema)


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds."""
    codebooks = first_entries(kept, parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = refine(kept, codebooks)
    return codebooks


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(``id_col``, code, error, label_error, codebooks_sha256) of every kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    every = settle(integer_vectors(vectors, id_col, vector_col, label_col, parts, scale), "codes-vectors")
    codebooks = first_entries(every, parts, entries)
    kept = every.where(F.col("dims") == codebooks.shape[0] * codebooks.shape[2])
    for _ in range(rounds if codebooks.size else 0):
        codebooks = refine(kept, codebooks)
    coded = settle(assign(kept, codebooks), "codes-assigned")
    forget(every)
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return coded.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
