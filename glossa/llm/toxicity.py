"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A token is a run of a-z and characters above ASCII (A-Z lower-cased). Its input is a hashed word vector plus hashed
vectors of its character n-grams (bytes of ``^word$``). Two gated recurrent layers read a window of ``WINDOW`` tokens
from either side, attention pools their states, and a logistic unit scores the window. Every text is cut into all
windows that overlap by half; the text's score is that of its worst window, so one insult in a long text counts.

Training (``train``) takes at most ``MAX_LABELLED`` labelled rows, half of either class: a documented bound of the fit alone.
Their texts count whole, and each text's worst window carries the gradient: ``ROUNDS`` times the worst windows are looked for (first by the
log-odds below, then by the network as far as trained), and then trained on for ``EPOCHS`` epochs. The first two coordinates of the vectors
start as log-odds of words and n-grams, counted crosswise: the rows are dealt into two halves at random, and a text is trained
with the log-odds of the other half, so no text sees its own label in its input; scoring takes those of both. The fit runs in one
executor task, over BLOCK bytes of text at a time; only the parameters come to the driver.

Defined cases: a null or empty text, or one without tokens, is a window of padding and gets that score (near 0); a very long text
is all its windows, whatever its length, in training and scoring; texts of equal worst windows have equal scores, and of equally
bad windows of a text the first carries the gradient; repeated rows are scored each; without labels of both classes every score is
the share of ones; an empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import held_out, labelled_sample, lower_bytes, raw, result_schema, span_hashes, string_blocks, word_spans

MAX_LABELLED = 5000
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 16
HIDDEN, DIM, ATTENTION = 8, 16, 8
WORDS, GRAMS, SIZES = 1 << 14, 1 << 16, (4, 6)
ROUNDS, EPOCHS, BATCH, LANES, BLOCK = 3, 3, 64, 2048, 1 << 21

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``counts`` tokens: the text of every window and its first token, within the text."""
    n = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))


class Tokens:
    """The tokens of a block of texts: distinct words with their n-grams, and windows of indexes into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data = lower_bytes(data)
        self.starts, self.ends = starts, ends = word_spans(_LETTER[data], offsets)
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = np.append((uniq % np.uint64(WORDS)).astype(np.int64), 0)
        self.gram, self.owner = self._grams(data, starts[at], ends[at])
        self.n = len(uniq)  # the index after the last word is padding
        self.first = first = np.searchsorted(starts, offsets)
        self.counts = np.diff(first)
        self.text, self.begin = windows(self.counts)
        begin = self.begin
        index = begin[:, None] + np.arange(WINDOW)
        inside = index < self.counts[self.text][:, None]
        padded = np.append(inverse, self.n)
        index = np.where(inside, index + first[self.text][:, None], len(inverse))
        self.window = padded[index].astype(np.int32)  # (windows, WINDOW)

    def spell(self, k: int) -> bytes:
        """The tokens of window ``k`` with blanks between."""
        a = self.first[self.text[k]] + self.begin[k]
        b = min(a + WINDOW, self.first[self.text[k] + 1])
        return b" ".join(self.data[x:y].tobytes() for x, y in zip(self.starts[a:b], self.ends[a:b], strict=True))

    @staticmethod
    def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts + 2
        edge = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint8)
        owner = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(out)) - edge[owner]
        source = np.clip(starts[owner] + inner - 1, 0, max(len(data) - 1, 0))
        if len(out):
            out[:] = data[source]
        out[edge], out[edge + size - 1] = ord("^"), ord("$")
        found, owners = [], []
        for n in SIZES:
            ok = inner + np.minimum(n, size[owner]) <= size[owner]
            p = np.flatnonzero(ok)
            found.append(span_hashes(out, p, p + np.minimum(n, size[owner[p]])) if len(p) else np.zeros(0, np.uint64))
            owners.append(owner[p])
        gram, who = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(who, kind="stable")
        return (gram[order] % np.uint64(GRAMS)).astype(np.int64), who[order]


class Network:
    """Parameters and passes of the network. The word and n-gram tables are rows of DIM numbers."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.words, self.grams = draw(WORDS, DIM, scale=0.05), draw(GRAMS, DIM, scale=0.05)
        self.p = {
            "wx": draw(DIM, 2 * 3 * HIDDEN, scale=0.35), "bx": np.zeros(2 * 3 * HIDDEN, np.float32),
            "u": draw(2, HIDDEN, 3 * HIDDEN, scale=0.25),
            "wa": draw(2 * HIDDEN, ATTENTION, scale=0.4), "ba": np.zeros(ATTENTION, np.float32), "va": draw(ATTENTION, scale=0.5),
            "wo": draw(2 * HIDDEN, scale=0.5), "bo": np.full(1, -1.0, np.float32),
        }
        self.constant: float | None = None

    def embed(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words and of padding, and each word's divisor of its n-gram sum."""
        e = np.zeros((t.n + 1, DIM), dtype=np.float32)
        scale = np.ones(t.n + 1, dtype=np.float32)
        if t.n:
            counts = np.bincount(t.owner, minlength=t.n)
            sums = np.add.reduceat(self.grams[t.gram], np.cumsum(counts) - counts, axis=0)
            scale[: t.n] = np.sqrt(counts)
            e[: t.n] = self.words[t.word[: t.n]] + sums / scale[: t.n, None]
        return e, scale

    def inputs(self, e: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 * HIDDEN) input terms of both directions; padding keeps the state."""
        x = (e @ self.p["wx"] + self.p["bx"]).reshape(-1, 2, 3 * HIDDEN).transpose(1, 0, 2).copy()
        x[:, -1, :] = 0
        x[:, -1, :HIDDEN] = -30
        return x

    def forward(self, x: np.ndarray, window: np.ndarray, keep: bool = False):
        """Log-odds of the windows; with ``keep`` also what the backward pass needs."""
        n, H = len(window), HIDDEN
        u = self.p["u"]
        h = np.zeros((2, n, H), dtype=np.float32)
        states = np.empty((WINDOW, n, 2 * H), dtype=np.float32)
        trail = []
        a = np.empty((2, n, 3 * H), dtype=np.float32)
        for s in range(WINDOW):
            np.take(x[0], window[:, s], axis=0, out=a[0], mode="clip")
            np.take(x[1], window[:, WINDOW - 1 - s], axis=0, out=a[1], mode="clip")
            m = h @ u
            gate = a[:, :, : 2 * H] + m[:, :, : 2 * H]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            z, r = gate[:, :, :H], gate[:, :, H:]
            mc = m[:, :, 2 * H :]
            c = r * mc
            c += a[:, :, 2 * H :]
            np.tanh(c, out=c)
            if keep:
                trail.append((h, gate, mc, c))
            h = h + z * (c - h)
            states[s, :, :H] = h[0]
            states[WINDOW - 1 - s, :, H:] = h[1]
        v = np.tanh(states.reshape(-1, 2 * H) @ self.p["wa"] + self.p["ba"])
        logits = (v @ self.p["va"]).reshape(WINDOW, n)
        logits[window.T == x.shape[1] - 1] -= 1e4
        logits -= logits.max(axis=0)
        alpha = np.exp(logits)
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        out = pooled @ self.p["wo"] + self.p["bo"][0]
        return (out, (trail, states, v.reshape(WINDOW, n, ATTENTION), alpha, pooled)) if keep else out

    def backward(self, window: np.ndarray, saved, d_out: np.ndarray, words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the small parameters and of the input terms of each distinct word."""
        trail, states, v, alpha, pooled = saved
        n, H, p = len(window), HIDDEN, self.p
        g = {k: np.zeros_like(w) for k, w in p.items()}
        g["wo"], g["bo"][0] = pooled.T @ d_out, d_out.sum()
        d_pool = d_out[:, None] * p["wo"]
        d_alpha = np.einsum("tnh,nh->tn", states, d_pool)
        d_states = alpha[:, :, None] * d_pool[None]
        d_logit = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_logit, v)
        d_v = d_logit[:, :, None] * p["va"] * (1 - v * v)
        flat = d_v.reshape(-1, ATTENTION)
        g["wa"], g["ba"] = states.reshape(-1, 2 * H).T @ flat, flat.sum(axis=0)
        d_states += (flat @ p["wa"].T).reshape(WINDOW, n, 2 * H)
        d_x = np.zeros((2, words, 3 * H), dtype=np.float32)
        d_h = np.zeros((2, n, H), dtype=np.float32)
        for s in range(WINDOW - 1, -1, -1):
            h, gate, mc, c = trail[s]
            z, r = gate[:, :, :H], gate[:, :, H:]
            d_h[0] += d_states[s, :, :H]
            d_h[1] += d_states[WINDOW - 1 - s, :, H:]
            d_c = d_h * z * (1 - c * c)
            d_a = np.concatenate((d_h * (c - h) * z * (1 - z), d_c * mc * r * (1 - r), d_c), axis=2)
            d_m = d_a.copy()
            d_m[:, :, 2 * H :] *= r
            g["u"] += h.transpose(0, 2, 1) @ d_m
            np.add.at(d_x[0], window[:, s], d_a[0])
            np.add.at(d_x[1], window[:, WINDOW - 1 - s], d_a[1])
            d_h = d_h * (1 - z) + d_m @ p["u"].transpose(0, 2, 1)
        d_x[:, -1, :] = 0
        return g, d_x

    def window_scores(self, t: Tokens) -> np.ndarray:
        x = self.inputs(self.embed(t)[0])
        return np.concatenate([self.forward(x, t.window[i : i + LANES]) for i in range(0, len(t.window), LANES)])

    def text_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text: that of its worst window."""
        n = len(offsets) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        t = Tokens(data, offsets)
        worst = np.maximum.reduceat(self.window_scores(t), np.searchsorted(t.text, np.arange(n)))
        return 1 / (1 + np.exp(-worst.astype(np.float64)))


def _pack(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return raw(pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary()))


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of BLOCK bytes, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _presence(texts: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, WORDS) and (2, GRAMS) counts of the texts of class 0 and 1 that have each hashed word and n-gram."""
    words, grams = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
    for i, j in _blocks(texts):
        t = Tokens(*_pack(texts[i:j]))
        label = y[i:j]
        doc, word = t.text.repeat(WINDOW), t.window.ravel()
        pairs = _distinct(doc[word < t.n].astype(np.int64) * (t.n + 1) + word[word < t.n])
        doc, word = pairs // (t.n + 1), pairs % (t.n + 1)
        counts = np.bincount(t.owner, minlength=t.n)
        first = np.cumsum(counts) - counts
        reps = counts[word]
        at = np.repeat(first[word], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        for out, ids, owner in ((words, t.word[word], doc), (grams, t.gram[at], np.repeat(doc, reps))):
            size = out.shape[1]
            pairs = _distinct(owner * size + ids)
            out += np.bincount(label[pairs // size] * size + pairs % size, minlength=2 * size).reshape(2, size)
    return words, grams


def _log_odds(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each hashed feature's presence in texts of class 1 against class 0."""
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    base = (counts.sum(axis=0) + 1) / (n1 + n0)
    return np.clip(np.log((counts[1] + 3 * base) / (n1 + 3)) - np.log((counts[0] + 3 * base) / (n0 + 3)), -3, 3).astype(np.float32)


def _worst(net: Network, texts: list, trained: bool) -> list[bytes]:
    """The worst window of each text, spelled out; before the network is trained, that of the largest log-odds."""
    out = []
    for i, j in _blocks(texts):
        t = Tokens(*_pack(texts[i:j]))
        logit = net.window_scores(t) if trained else net.embed(t)[0][:, :2].sum(axis=1)[t.window].sum(axis=1)
        edge = np.searchsorted(t.text, np.arange(j - i + 1))
        out += [t.spell(a + int(logit[a:b].argmax())) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def fit(texts: list, y: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Train on texts (strings or UTF-8 bytes) with labels 0 and 1, in the given order."""
    net = Network(seed)
    y = np.asarray(y, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    halves = [order[::2], order[1::2]]
    counts = [_presence([texts[i] for i in h], y[h]) for h in halves]
    # What a text of either half sees (the log-odds of the other one), and at last those of both.
    sees = [[_log_odds(counts[1 - f][k], y[halves[1 - f]]) for k in (0, 1)] for f in (0, 1)]
    sees.append([_log_odds(counts[0][k] + counts[1][k], y) for k in (0, 1)])
    net.words[:, :2] = 0
    net.grams[:, :2] = 0
    net.words[:, 0], net.grams[:, 1] = sees[0]
    now = 0

    def see(f: int) -> None:
        nonlocal now
        net.words[:, 0] += sees[f][0] - sees[now][0]
        net.grams[:, 1] += sees[f][1] - sees[now][1]
        now = f

    momentum = {k: [np.zeros_like(w), np.zeros_like(w)] for k, w in net.p.items()}
    spent = {"words": np.full(WORDS, 1e-3, np.float32), "grams": np.full(GRAMS, 1e-3, np.float32)}
    step, steps = 0, rounds * epochs
    windows_of: dict[int, bytes] = {}
    for epoch in range(steps):
        if epoch % epochs == 0:
            for f in (0, 1):
                see(f)
                windows_of |= zip(halves[f].tolist(), _worst(net, [texts[k] for k in halves[f]], epoch > 0), strict=True)
        rate = 0.02 * (1 - 0.8 * epoch / max(steps - 1, 1))
        batches = [(f, rows[i : i + BATCH]) for f in (0, 1) for rows in [rng.permutation(halves[f])] for i in range(0, len(rows), BATCH)]
        for b in rng.permutation(len(batches)):
            f, rows = batches[b]
            see(f)
            t = Tokens(*_pack([windows_of[k] for k in rows.tolist()]))
            e, scale = net.embed(t)
            out, saved = net.forward(net.inputs(e), t.window, keep=True)
            prob = 1 / (1 + np.exp(-out))
            weight = np.where(y[rows] == 1, 1.0, 1.5).astype(np.float32)
            d_out = ((prob - y[rows]) * weight / len(rows)).astype(np.float32)
            g, d_x = net.backward(t.window, saved, d_out, t.n + 1)
            d_in = d_x.transpose(1, 0, 2).reshape(t.n + 1, -1)
            g["wx"], g["bx"] = e.T @ d_in, d_in.sum(axis=0)
            d_e = (d_in @ net.p["wx"].T)[: t.n]
            step += 1
            for k, w in net.p.items():
                m, v = momentum[k]
                m += 0.1 * (g[k] - m)
                v += 0.005 * (g[k] ** 2 - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
            for table, ids, grad in (("words", t.word[: t.n], d_e), ("grams", t.gram, d_e[t.owner] / scale[t.owner, None])):
                if len(ids):
                    order = np.argsort(ids, kind="stable")
                    edge = np.flatnonzero(np.append(True, np.diff(ids[order])))
                    ids, grad = ids[order][edge], np.add.reduceat(grad[order], edge, axis=0)
                    spent[table][ids] += (grad**2).mean(axis=1)
                    getattr(net, table)[ids] -= 0.05 * grad / np.sqrt(spent[table][ids])[:, None]
    see(2)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> Network:
    """Fit on at most ``limit`` labelled rows, in one executor task; the parameters alone come to the driver."""
    rows = labelled_sample(docs, labels, label, limit, each=True).select(F.col("doc_id").cast("string").alias("doc_id"), "y", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((i, t, y) for b in batches for i, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True))
        net = fit([t for _, t, _ in table], np.array([y for _, _, y in table], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(net), 1)], pa.binary())], names=["net"])

    found = rows.repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(zlib.decompress(found["net"])) if found else fit([], np.zeros(0))


def score(docs: DataFrame, net: Network, columns: list[str] | None = None) -> DataFrame:
    """(_row, _score) of every row of ``docs``: a struct of ``columns`` (its id by default), whatever their names, and a score from 0 to 1."""
    base = docs.select(F.struct(*(columns or ["doc_id"])).alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, arr in string_blocks(batch, "_text", 1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(net.text_scores(*raw(arr)))], names=["_row", "_score"])

    return base.mapInArrow(run, result_schema(base.select("_row").schema, "_score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return score(docs, train(docs, labels, "toxic", limit)).select(
        "_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns."""
    return score(docs, train(docs, labels, "toxic", limit), docs.columns).where(F.col("_score") < threshold).select("_row.*")
