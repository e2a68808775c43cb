"""Document fingerprints: order MinHash, sensitive to edit distance.

A text's k-mers (``K`` bytes of UTF-8; a shorter text is one k-mer) are numbered by occurrence, so the second "the"
differs from the first. For each of ``SKETCHES`` hash functions (an odd multiple of the numbered k-mer's mixed hash) the
``TUPLE`` minimal k-mers of the whole text are taken, put back into text order and hashed together: a text with the same
k-mers in another order gets other tuples. The fingerprint is the hex of 16 bits a sketch; the likeness of two
fingerprints is the share of equal sketches, brought to the scale of one k-mer (power 1 / TUPLE). The k-mers pass in
blocks of ``BLOCK`` with running minima, which bounds the memory and leaves the values as they are.

``with_next`` pairs each document with the next one by id without gathering the table: ids are cut at quantiles into
ranges, each range is one task, and the first row of a range is also sent to the range before.

Defined cases: a null or empty text has the fingerprint of zeros (likeness 1 to another empty one, 0 to the rest); a very long text is worked in
blocks; rows of equal id follow each other by text; ids may be of any type that sorts - those that are no whole numbers are numbered first - and null ids
come first; different k-mers of equal 64-bit hashes count as one; a single document is its own successor; an empty table gives an empty result; other
columns are not read and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from glossa.llm.common import mix, partitions, result_schema, settle, span_hashes

K, TUPLE, SKETCHES, BLOCK = 8, 2, 64, 1024
_FACTORS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ROOM = np.empty(SKETCHES * BLOCK, dtype=np.uint64)  # one block's hashes; a fresh array each time would cost more than the hashing
_PLACE = np.uint64(24)


def _two(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the TUPLE least entries of each row, in order; ``table`` is overwritten."""
    rows = np.arange(len(table))
    at, least = [], []
    for _ in range(min(TUPLE, table.shape[1])):
        at.append(table.argmin(axis=1))
        least.append(table[rows, at[-1]])
        table[rows, at[-1]] = np.uint64(2**64 - 1)
    return np.stack(at, axis=1), np.stack(least, axis=1)


def minima(value: np.ndarray) -> np.ndarray:
    """For each sketch the indices of the TUPLE values with the smallest hashes, in order of hash."""
    best = least = None
    for start in range(0, len(value), BLOCK):
        part = value[start : start + BLOCK]
        room = _ROOM[: SKETCHES * len(part)].reshape(SKETCHES, len(part))
        at, low = _two(np.multiply(part[None, :], _FACTORS[:, None], out=room))
        if best is None:
            best, least = at, low
            continue
        both = np.concatenate([best, at + start], axis=1)
        order, least = _two(np.concatenate([least, low], axis=1))
        best = np.take_along_axis(both, order, axis=1)
    return best


def order_minhash(text: str) -> np.ndarray:
    """The SKETCHES 16-bit values of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(SKETCHES, dtype=np.uint16)
    k = min(K, len(data))
    starts = np.arange(len(data) - k + 1)
    h = span_hashes(data, starts, starts + k)
    if len(h) <= 1 << 24:  # the hash's upper 40 bits and the place sort as one number
        both = np.sort((h >> _PLACE << _PLACE) | starts.astype(np.uint64))
        value, place = both >> _PLACE, both & np.uint64((1 << 24) - 1)
    else:
        value = h >> _PLACE
        place = np.argsort(value, kind="stable").astype(np.uint64)
        value = value[place]
    fresh = np.empty(len(value), dtype=bool)
    fresh[0] = True
    np.not_equal(value[1:], value[:-1], out=fresh[1:])
    run = np.flatnonzero(fresh)
    number = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    picked = minima(value)
    picked = np.take_along_axis(picked, place[picked].argsort(axis=1, kind="stable"), axis=1)
    out = np.full(SKETCHES, picked.shape[1], dtype=np.uint64)
    for j in range(picked.shape[1]):
        out = mix(out * np.uint64(0x100000001B3) + value[picked[:, j]])
    return np.maximum(out >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def to_text(sketches: np.ndarray) -> str:
    return sketches.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean() ** (1 / TUPLE))


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a further column ``name`` (replacing one of that name)."""
    rest = [c for c in docs.columns if c != name]
    base = docs.select(F.struct(*rest).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [to_text(order_minhash(t or "")) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(prints, pa.string())], names=["_row", name])

    return base.mapInArrow(run, result_schema(base.select("_row").schema, f"`{name}` string")).select("_row.*", name)


def _task_keys(spark, n: int) -> list[int]:
    """For each of ``n`` tasks a number that hash partitioning sends there: as many numbers as tasks, no more."""
    rows = (
        spark.range(30 * n + 100).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("task")).groupBy("task").agg(F.min("id").alias("id")).collect()
    )
    found = {r["task"]: r["id"] for r in rows}
    return [found[t] for t in range(n) if t in found]


def _numbers(ids: DataFrame, n: int) -> DataFrame:
    """(_id, _ord) of the distinct ids that are not null, numbered in their order: sorted in ranges, with the sizes of the ranges before added."""
    ids = ids.where(F.col("_id").isNotNull()).distinct().repartitionByRange(n, "_id").sortWithinPartitions("_id")
    ids = settle(ids.select("_id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k")), "fingerprint-ids")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = ids.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ids.join(F.broadcast(starts), "_p").select("_id", (F.col("_start") + F.col("_k")).alias("_ord"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Rows (_range, _after, _ord, id, text) dealt so that each task holds whole ranges of ids in order.

    ``_after`` is 1 for the copy of the next range's first row, which ends a range.
    """
    spark = docs.sparkSession
    n = tasks or partitions(spark)
    least = F.lit(-(2**63))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        rows = rows.withColumn("_ord", F.coalesce(F.col("_id").cast("long"), least))
    else:
        rows = rows.join(_numbers(rows.select("_id"), n), "_id", "left").withColumn("_ord", F.coalesce("_ord", least))
    rows = rows.select("_ord", "_id", "_text")
    cuts = rows.agg(F.percentile_approx("_ord", [i / n for i in range(1, n)] or [0.5], 10000).alias("c")).first()["c"] or []
    edges = np.unique(np.array(cuts, dtype=np.int64))
    keys = np.array(_task_keys(spark, n), dtype=np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = batch.column("_ord").to_numpy()
            at = np.searchsorted(edges, o, side="right")
            for r in np.unique(at):
                yield pa.RecordBatch.from_arrays([pa.array([int(r)]), pa.array([int(o[at == r].min())])], names=["r", "o"])

    # One row a range: the list is as long as there are tasks.
    heads = sorted((x["r"], x["o"]) for x in rows.select("_ord").mapInArrow(ranges, "r long, o long").groupBy("r").agg(F.min("o").alias("o")).collect())
    before = {o: heads[i - 1][0] for i, (_, o) in enumerate(heads)}
    head_ids = np.array(sorted(before), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_range", "_key", "_after", "_ord", "_id", "_text"]
        for batch in batches:
            o = batch.column("_ord").to_numpy()
            at = np.searchsorted(edges, o, side="right").astype(np.int64)
            cols = [batch.column(c) for c in ("_ord", "_id", "_text")]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(keys[at % len(keys)]), pa.array(np.zeros(len(o), np.int32)), *cols], names=names)
            copy = np.flatnonzero(np.isin(o, head_ids))
            if len(copy):
                at = np.array([before[int(x)] for x in o[copy]], dtype=np.int64)
                take = pa.array(copy)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(keys[at % len(keys)]), pa.array(np.ones(len(at), np.int32)), *[c.take(take) for c in cols]], names=names)

    schema = StructType([*StructType.fromDDL("_range long, _key long, _after int, _ord long").fields, *rows.select("_id", "_text").schema.fields])
    dealt = rows.mapInArrow(deal, schema)
    return dealt.repartition(n, "_key").sortWithinPartitions("_range", "_after", "_ord", "_text").drop("_key")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document.

    The edit replaces the last quarter of the code points by the first as many of the next document by id (after the
    last: the first). Columns: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs, id_col, text_col)

    added = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = result_schema(StructType([docs.schema[id_col]]), added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: range, id, text, sketches
        for batch in batches:
            out: list[tuple] = []
            for r, after, i, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_after", "_id", "_text")), strict=True):
                mine = order_minhash(text) if held is None or held[0] == r or not after else None
                if held is not None and held[0] == r:
                    _, hid, htext, hprint = held
                    cut = len(htext) // 4
                    edited = htext[: len(htext) - cut] + text[:cut]
                    eprint = order_minhash(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((hid, len(htext), digest, to_text(hprint), to_text(eprint), likeness(hprint, eprint), likeness(hprint, mine)))
                    held = None
                if not after:
                    held = (r, i, text, mine)
            kinds = (batch.schema.field("_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=schema.names)
        assert held is None, "a range without its end"

    return rows.mapInArrow(run, schema)
