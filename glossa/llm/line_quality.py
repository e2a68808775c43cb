"""Quality rules by line labels: a linear-chain conditional random field marks each line content or boilerplate, the content's share decides.

``Page`` cuts a block of texts into words and lines and counts the base rules' statistics and the lines' features, all over whole texts. The field
has two labels, weights over line features and over label changes between neighbouring lines; ``viterbi`` decodes all texts of a block side by
side, line by line. A text is kept if it passes the base rules and at least ``SHARE`` of its words' characters stand in content lines.

There are no labels of lines, only of documents, so ``fit`` starts from those - every line of a document of good quality is content, every line of
another boilerplate - and refits three times with the other documents' lines relabelled by the last fit (content lines in bad documents become
content; good documents keep theirs). Training takes at most ``MAX_LABELLED`` labelled rows chosen by a hash of doc_id, half of either class, and never
held-out ones (crc32 mod 5 is 0); every text is decoded whole.

Defined cases: a null or empty text, or one without words, has all counts 0 and is not kept (fewer than 20 words fail); lines without a
word are no lines of the sequence; equal lines are equal bytes, the first of them is no repeat; a very long text is one sequence in a block by itself, in memory in
proportion to it; of equally good label paths content wins; repeated rows get a verdict each; without usable labels every line is content, so the base
rules alone decide; an empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import labelled_sample, raw, result_schema, string_blocks, word_spans

MAX_LABELLED = 4000
SHARE = 0.5
MIN_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
STEPS, RATE, L2, REFITS = 120, 0.1, 1e-3, 3

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,:;?!"]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_WIDE = np.zeros(256, dtype=bool)
_WIDE[128:] = True
_HEAD = np.ones(256, dtype=np.int64)  # bytes that start a code point
_HEAD[0x80:0xC0] = 0
N_FEATURES = 16


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte span, equal for equal bytes only."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    packed = data[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)]
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return spans.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, equal for equal pairs only."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[bounds])


@dataclass
class Page:
    """Counts of a block's texts, and its lines with a word: which text each is of, its words' characters and its features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    owner: np.ndarray
    chars: np.ndarray
    features: np.ndarray  # (lines, N_FEATURES)

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> Page:
        n = len(offsets) - 1
        starts, ends = word_spans(~_SPACE[data], offsets)
        first = np.searchsorted(starts, offsets)
        heads = np.concatenate(([0], np.cumsum(_HEAD[data])))
        chars = heads[ends] - heads[starts]
        words = _distinct(data, starts, ends)
        text = np.repeat(np.arange(n), np.diff(first))
        repeated = _repeated(words, text, window)
        # Lines: cut at line feeds and text borders; those without a word drop out.
        cuts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
        cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
        line_end = np.append(cuts[1:], len(data))
        line_first = np.searchsorted(starts, np.append(cuts, len(data)))
        full = np.diff(line_first) > 0
        line_start, line_end, p, q = cuts[full], line_end[full], line_first[:-1][full], line_first[1:][full]
        owner = text[p] if len(p) else np.zeros(0, np.int64)
        shown = np.where((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(p) else line_end
        line = _ranked(owner, _distinct(data, line_start, shown)) if len(p) else np.zeros(0, np.int64)
        earlier = np.ones(len(line), dtype=bool)
        earlier[np.unique(line, return_index=True)[1]] = False
        lines_at = np.searchsorted(owner, np.arange(n + 1))
        features = _features(data, starts, ends, line_start, shown, p, q, words, repeated, earlier) if len(p) else np.zeros((0, N_FEATURES))
        return cls(np.diff(first), _sums(chars, first), _sums(_SYMBOL[data], offsets), _sums(earlier, lines_at), _sums(repeated, first), owner, np.add.reduceat(chars, p) if len(p) else np.zeros(0, np.int64), features)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words)


def _repeated(words: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window of ``window`` words that its text holds twice or more."""
    out = np.zeros(len(words), dtype=bool)
    if len(words) < window:
        return out
    # Runs of 1, 2, 4 ... words are numbered by pairs of numbers, exactly; a window is two overlapping such runs.
    run, size = words, 1
    while 2 * size <= window:
        run, size = _ranked(run[:-size], run[size:]), 2 * size
    if size < window:
        run = _ranked(run[: len(words) - window + 1], run[window - size :])
    inside = text[: len(run)] == text[window - 1 :]
    run = _ranked(run, text[: len(run)])
    twice = inside & (np.bincount(run[inside], minlength=int(run.max()) + 1)[run] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[: len(run)] += twice
    edge[window : window + len(run)] -= twice
    return np.cumsum(edge[:-1]) > 0


def _features(data, starts, ends, line_start, line_end, p, q, words, repeated, earlier) -> np.ndarray:
    n, m = line_end - line_start, q - p

    def within(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        return total[line_end] - total[line_start]

    by_word = lambda x: np.add.reduceat(x.astype(np.float64), p)
    last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[p] = False
    length = (ends - starts).astype(np.float64)
    letters = np.maximum(within(_UPPER) + within(_LOWER) + within(_WIDE), 1)
    x = np.stack(
        [
            np.ones(len(n)), np.log1p(m) / 3, within(_SYMBOL) / n * 10, within(_UPPER) / letters * 4, within(_DIGIT) / n * 10, within(_MARK) / n * 10,
            by_word(_SYMBOL[last]) / m * 4, by_word((last == 33) & (ends - starts > 2) & (before == 33)) / m * 4, by_word(again) / m * 4, by_word(repeated) / m * 2,
            earlier, by_word(length) / m / 8, by_word(ends - starts == 1) / m * 4, _MARK[last[q - 1]], _UPPER[data[starts[p]]] | _WIDE[data[starts[p]]], m < 4,
        ],
        axis=1,
    )
    return x.astype(np.float64)


@dataclass
class Field:
    """Weights of line features for boilerplate against content, of label pairs of neighbouring lines, and of the first line's label."""

    weights: np.ndarray  # (N_FEATURES,)
    step: np.ndarray  # (2, 2) from label to label; 0 content, 1 boilerplate
    start: np.ndarray  # (2,)

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))

    def emit(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(features)), features @ self.weights], axis=1)

    def viterbi(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The best label of each line; lines of one ``owner`` stand together, in order."""
        emit, label = self.emit(features), np.zeros(len(features), dtype=np.int64)
        back = np.zeros((len(features), 2), dtype=np.int8)
        score = np.zeros((len(features), 2))
        for t, (rows, prior) in enumerate(_columns(owner)):
            if t == 0:
                score[rows] = self.start + emit[rows]
                continue
            way = score[prior][:, :, None] + self.step
            back[rows] = way.argmax(axis=1)
            score[rows] = way.max(axis=1) + emit[rows]
        columns = list(_columns(owner))
        last = np.ones(len(owner), dtype=bool)
        last[:-1] = owner[1:] != owner[:-1]
        label[last] = score[last].argmax(axis=1)
        for rows, prior in reversed(columns[1:]):
            label[prior] = back[rows, label[rows]]
        return label


def _columns(owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first lines of all texts, then their second ones and so on, each with the lines before them."""
    if not len(owner):
        return
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(begin, len(owner)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    for t in range(int(size[0])):
        rows = begin[: int(np.searchsorted(-size, -t, side="left"))] + t
        yield rows, rows - 1


def gradient(field: Field, features: np.ndarray, owner: np.ndarray, label: np.ndarray, columns: list | None = None) -> tuple[float, Field]:
    """Log-likelihood of ``label`` and its gradient, by running forward and backward over all texts side by side."""
    columns = list(_columns(owner)) if columns is None else columns
    emit = field.emit(features)
    n = len(owner)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t, (rows, prior) in enumerate(columns):
        if t == 0:
            forward[rows] = field.start + emit[rows]
        else:
            way = forward[prior][:, :, None] + field.step
            forward[rows] = np.logaddexp(way[:, 0], way[:, 1]) + emit[rows]
    for rows, prior in reversed(columns[1:]):
        way = field.step + (emit[rows] + backward[rows])[:, None, :]
        backward[prior] = np.logaddexp(way[:, :, 0], way[:, :, 1])
    # The total of a text, known at each of its lines.
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both - total[:, None])
    head = columns[0][0]
    later = np.setdiff1d(np.arange(n), head, assume_unique=True)
    pair = np.exp(forward[later - 1][:, :, None] + field.step + (emit[later] + backward[later])[:, None, :] - total[later][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[later - 1], label[later]), 1)
    reached = emit[np.arange(n), label].sum() + field.start[label[head]].sum() + (field.step * seen).sum()
    first = np.bincount(label[head], minlength=2) - p[head].sum(axis=0)
    return float(reached - total[head].sum()), Field(features.T @ (label - p[:, 1]), seen - pair.sum(axis=0), first)


def climb(features: np.ndarray, owner: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """The field that makes ``label`` likeliest, with a small pull to zero, by Adam."""
    columns = list(_columns(owner))
    x, n = np.zeros(N_FEATURES + 6), max(len(owner), 1)
    unpack = lambda v: Field(v[:N_FEATURES], v[N_FEATURES : N_FEATURES + 4].reshape(2, 2), v[N_FEATURES + 4 :])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        _, g = gradient(unpack(x), features, owner, label, columns)
        g = np.concatenate((g.weights, g.step.ravel(), g.start)) / n - L2 * x
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return unpack(x)


def fit(features: np.ndarray, owner: np.ndarray, good: np.ndarray, refits: int = REFITS) -> Field:
    """From ``good`` for each line (is its document of good quality): fit, relabel the others' lines, fit again."""
    bad = ~good
    if not bad.any() or not good.any():
        return Field.blank()
    label = bad.astype(np.int64)
    field = climb(features, owner, label)
    for _ in range(refits):
        found = field.viterbi(features, owner) * bad
        if not found.any() or (found == label).all():
            break
        label = found
        field = climb(features, owner, label)
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> Field:
    """Fit on at most ``limit`` labelled rows: features where the texts are, the fit in one executor task, the weights to the driver."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, arr in string_blocks(batch, "text"):
                page = Page.read(*raw(arr))
                at = np.searchsorted(page.owner, np.arange(b - a + 1))
                x = [page.features[p:q].astype("<f4").tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "y")), strict=True))
        x = np.frombuffer(b"".join(r[1] for r in rows), dtype="<f4").reshape(-1, N_FEATURES).astype(np.float64)
        size = [len(r[1]) // (4 * N_FEATURES) for r in rows]
        field = fit(x, np.repeat(np.arange(len(rows)), size), np.repeat([r[2] == 1 for r in rows], size).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])

    rows = labelled_sample(docs, labels, label, limit, each=True)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInArrow(featurise, "doc_id string, y int, x binary")
    found = rows.repartition(1).mapInArrow(learn, "field binary").first()
    return pickle.loads(found["field"]) if found else Field.blank()


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ADDED = ", ".join(f"_{c} long" for c in _BASE) + ", _base_failed boolean, _share double, _kept boolean"


def judge(docs: DataFrame, field: Field, columns: list[str], share: float = SHARE) -> DataFrame:
    """A struct ``_row`` of ``columns`` of every row of ``docs``, whatever their names, with the counts, the content's share and the verdict."""
    base = docs.select(F.struct(*columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = result_schema(base.select("_row").schema, _ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, arr in string_blocks(batch, "_text"):
                page = Page.read(*raw(arr))
                label = field.viterbi(page.features, page.owner)
                content = np.bincount(page.owner, page.chars * (label == 0), minlength=b - a)
                part = content / np.maximum(page.word_chars, 1)
                failed = page.base_failed
                out = [*(getattr(page, c).astype(np.int64) for c in _BASE), failed, part, ~failed & (part >= share)]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), *map(pa.array, out)], names=schema.names)

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, share: float = SHARE, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the base rules' counts, base_failed, content_share and kept of every row of ``docs``."""
    found = judge(docs, train(docs, labels, limit=limit), ["doc_id"], share)
    return found.select("_row.doc_id", *(F.col(f"_{c}").alias(c) for c in _BASE), F.col("_base_failed").alias("base_failed"), F.col("_share").alias("content_share"), F.col("_kept").alias("kept"))


def keep_content(docs: DataFrame, labels: DataFrame, share: float = SHARE, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judge(docs, train(docs, labels, limit=limit), docs.columns, share).where("_kept").select("_row.*")
