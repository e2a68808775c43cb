"""Shared helpers: the shared work folder, written intermediates, and byte-level text kernels in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glossa.sources.work import exchanges_go, forget, settle, shared_path  # noqa: F401  used by the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_KEY = _RNG.integers(1, 2**63, dtype=np.uint64)
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG_SPAN = 128


def result_schema(kept: StructType, added: str) -> StructType:
    """The fields of ``kept`` and then those of the DDL string ``added``, all nullable."""
    fields = [*kept.fields, *StructType.fromDDL(added).fields]
    return StructType([StructField(f.name, f.dataType, True) for f in fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z to a-z and nothing else; null counts as empty. All-ASCII texts take the fast built-in path."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def held_out(doc_id):
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, each: bool = False) -> DataFrame:
    """(doc_id, y int, text string) of at most ``limit`` labelled training rows, chosen by a hash of doc_id.

    Held-out rows and null labels never take part. With ``each``, half of the limit goes to either class. The chosen
    ids are at most ``limit`` rows, so broadcasting them is bounded by that parameter whatever the corpus's size.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min(F.least(F.greatest(F.col(label).cast("int"), F.lit(0)), F.lit(1))).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    if each:
        ids = usable.where("y = 1").orderBy(*order).limit(limit // 2)
        ids = ids.unionByName(usable.where("y = 0").orderBy(*order).limit(limit - limit // 2))
    else:
        ids = usable.orderBy(*order).limit(limit)
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    # Of an id with many rows one text counts, the least: the sample stays within its limit whatever the ids repeat.
    return text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def string_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges (start, stop, strings) of about ``max_bytes`` of text each, so that numpy temporaries stay small."""
    arr = batch.column(column)
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    sizes = np.cumsum(pc.binary_length(arr).to_numpy(zero_copy_only=False))
    start, n = 0, len(arr)
    while start < n:
        base = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + max_bytes, side="right")))
        yield start, stop, arr.slice(start, stop - start)
        start = stop


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    wide = arr.type in (pa.large_string(), pa.large_binary())
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if buffers[2] is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``; equal bytes give equal hashes wherever they stand.

    Eight bytes at a time are mixed in by a keyed bijection, so spans that differ in one block of eight never collide and others do
    by chance only. Spans over LONG_SPAN bytes go through BLAKE2b.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _KEY)
    if not len(size):
        return h
    h ^= eight[starts] & _MASK[np.minimum(size, 8)]
    mix(h)
    more = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(more):
        part = (h[more] * np.uint64(0xD6E8FEB86659FD93)) ^ (eight[starts[more] + done] & _MASK[np.minimum(size[more] - done, 8)])
        h[more] = mix(part)
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True in ``keep`` that do not cross the text borders in ``offsets``."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(keep)
    before[0], before[1:] = False, keep[:-1]
    after = np.empty_like(keep)
    after[-1], after[:-1] = False, keep[1:]
    inner = offsets[(offsets > 0) & (offsets < len(keep))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of ``width``-word shingles, of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.

    Fewer words give one shingle of the whole sequence; no words give an empty set.
    """
    data = _LOWER[data]
    starts, ends = word_spans(~_SPACE[data], offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    whole = _combine(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            h = np.sort(whole[a : b - width + 1])
            fresh = np.empty(len(h), dtype=bool)
            fresh[0] = True
            np.not_equal(h[1:], h[:-1], out=fresh[1:])
            out.append(h[fresh])
        else:
            out.append(_combine(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _combine(words: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(words) - k + 1, int(k) * 0x632BE59BD9B4E019 % 2**64, dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : len(words) - k + 1 + j]
    return mix(h)


def shingle_set(text: str | bytes, width: int = 5) -> np.ndarray:
    """The shingle set of one text."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, dtype=np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), width)[0]
