"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_features`` turns a whole text into fixed statistics (never from labels, language, source or id). ``fit``
grows complete trees of a fixed depth on binned features with logistic loss; they are flattened into arrays in heap
order (children of node i: 2i+1, 2i+2), and ``Forest.predict`` walks all trees of all rows at once by numpy indexing.

Training takes at most ``MAX_LABELLED`` labelled rows, chosen by a hash of doc_id (a documented bound); every text is
scored whole. Defined cases: a null or empty text has all statistics 0 and gets a score like any other; a very long text is one
row of statistics like any other, in memory by itself; a value equal to a split's threshold goes left, and of equally good splits the
first feature and cut wins; repeated rows are scored each; without any usable label every score is 0.5; an empty table
gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import held_out, labelled_sample, lower_bytes, raw, result_schema, span_hashes, string_blocks, word_spans

MAX_LABELLED = 6000
N_TREES, DEPTH, BINS, RATE, L2 = 50, 4, 48, 0.2, 2.0
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 control, 1 space, 2 lower, 3 upper, 4 digit, 5 symbol, 6 sentence mark, 7 above ASCII, 8 line feed
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
_CLASS[10] = 8
_CLASS[[ord(c) for c in "!\"#$%&'()*+-/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[ord(c) for c in ".,:;?"]] = 6
_SPACED = np.isin(_CLASS, (1, 8))
N_FEATURES = 26


def document_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) statistics of the texts whose bytes lie in ``data`` between ``offsets``."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    kinds = _CLASS[data]
    starts, ends = word_spans(~_SPACED[data], offsets)
    hashes = span_hashes(lower_bytes(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    tail = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = kinds[starts] if len(starts) else np.zeros(0, np.uint8)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            continue
        k, size = kinds[a:b], float(b - a)
        share = np.bincount(k, minlength=9) / size
        out[i, :10] = np.log1p(size), *share[[1, 2, 3, 4, 5, 6, 7, 8]], share[3] / max(share[2] + share[3] + share[7], 1e-9)
        lines = np.flatnonzero(k == 8)
        edges = np.concatenate(([0], lines + 1))
        edges = edges[edges < len(k)]
        if len(edges):
            length = np.diff(np.append(edges, len(k))).astype(np.float32)
            odd = np.add.reduceat((k == 5).astype(np.float32), edges) / length
            loud = np.add.reduceat((k == 3).astype(np.float32), edges) / length
            wide = length / size
            out[i, 10:16] = odd.max(), loud.max(), float((odd * wide).sum()), float(wide[odd > 0.04].sum()), float(wide[loud > 0.3].sum()), length.mean()
        p, q = first[i], first[i + 1]
        m = q - p
        if not m:
            continue
        h = hashes[p:q]
        values, counts = np.unique(h, return_counts=True)
        out[i, 16:26] = (
            np.log1p(m), (ends[p:q] - starts[p:q]).mean(), len(values) / m, len(values) / np.sqrt(m), counts.max() / m,
            (h[1:] == h[:-1]).mean() if m > 1 else 0.0, (tail[p:q] == 5).mean(), (head[p:q] == 5).mean(),
            ((ends[p:q] - starts[p:q]) == 1).mean(), len(np.unique(h[1:] ^ (h[:-1] * np.uint64(3)))) / max(m - 1, 1),
        )
    return out


@dataclass
class Forest:
    """Complete trees of one depth: split features and thresholds in heap order, leaf values, and a base log-odds."""

    feature: np.ndarray  # (trees, 2**depth - 1) int
    threshold: np.ndarray  # (trees, 2**depth - 1)
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base, dtype=np.float64)
        if not len(self.leaf) or not len(x):
            return total
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        inner = self.feature.shape[1]
        while node.size and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return total + self.leaf[trees, node - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw_score(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = N_TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Forest:
    """Boosted trees with second-order gains on ``bins`` quantile bins a feature."""
    inner = 2**depth - 1
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones))) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, inner))
        return Forest(empty.astype(int), empty, np.zeros((0, inner + 1)), base)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    flat = binned + np.arange(d) * bins
    score = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, offset = 2**level, 2**level - 1
            at = ((node - offset)[:, None] * (d * bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
            gain[(h < 1) | (whole_h - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, offset + k], threshold[t, offset + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        slot = node - inner
        value = -np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + l2) * rate
        leaf[t] = value
        score += value[slot]
    return Forest(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> Forest:
    """Fit on at most ``limit`` labelled rows: statistics where the texts are, trees in one executor task, the trees to the driver."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, arr in string_blocks(batch, "text"):
                x = document_features(*raw(arr))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], names=["doc_id", "y", "x"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "y")), strict=True))
        x = np.frombuffer(b"".join(v for _, v, _ in table), dtype="<f4").reshape(len(table), N_FEATURES)
        forest = fit(x.astype(np.float64), np.array([y for _, _, y in table], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)], pa.binary())], names=["forest"])

    rows = labelled_sample(docs, labels, label, limit)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInArrow(featurise, "doc_id string, y int, x binary")
    found = rows.repartition(1).mapInArrow(grow, "forest binary").first()
    return pickle.loads(found["forest"]) if found else fit(np.zeros((0, N_FEATURES)), np.zeros(0))


def score(docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """(_row, _score) of every row of ``docs``: a struct of ``columns`` (its id by default), whatever their names, and a score from 0 to 1."""
    columns = columns or ["doc_id"]
    base = docs.select(F.struct(*columns).alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, arr in string_blocks(batch, "_text"):
                scores = forest.predict(document_features(*raw(arr)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(scores)], names=["_row", "_score"])

    return base.mapInArrow(run, result_schema(base.select("_row").schema, "_score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    forest = train(docs, labels, "quality", limit)
    return score(docs, forest).select(
        "_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    forest = train(docs, labels, "quality", limit)
    return score(docs, forest, docs.columns).where(F.col("_score") >= threshold).select("_row.*")
