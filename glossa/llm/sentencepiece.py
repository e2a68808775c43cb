"""SentencePiece encoding and decoding as a max-plus parallel scan.

The vocabulary file's pieces and scores are read as a unigram model: the encoding of a text is the segmentation of greatest
total score (ties: the longer earlier piece), characters that no piece covers fall back to byte pieces, and decoding gives
the text back exactly. A file of merge type holds ranks as scores; it is used with those scores, so its ids are those of the library
run in unigram mode on it and not those of its merge procedure, which no scan over scores can reproduce.

Where two characters follow each other in no piece, no piece crosses: the text is cut there (before spaces, around most signs), and each
segment is worked out once and remembered.
A text over ``CHUNK`` characters is cut into chunks of that size, wherever the cuts fall, and its chunks are dealt to tasks:

1. each chunk yields a transfer matrix: entry (s, t) is the best score of covering it when a piece from before takes its first
   s characters and its own last piece takes t characters of the next chunk;
2. the matrices are combined by max-plus products, which are associative, in a doubling scan; the running products give the best
   score of every entry state of every chunk;
3. with those, each chunk alone finds which entry state each of its exit states goes back to; composing these maps from the end gives
   the state at every border, with ties broken as in one go over the whole text;
4. each chunk is then traced back alone, between its two states.

Defined cases: a null or empty text has no tokens; spaces are kept as they are (a leading one is added for encoding and taken off
again); the character U+2581 in a text is written as bytes, so it isn't taken for a space; repeated rows are encoded each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glossa.llm.common import partitions, settle

CHUNK = 1 << 15
REMEMBER, SCORES = 300_000, 30_000
PLAIN = 1024  # cuts are looked up for characters below this code point; others never end a segment
NEVER = -np.inf


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : (at := at + 8)]
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : (at := at + n)]
        else:
            yield tag >> 3, data[at : (at := at + 4)]


class _Memory(dict):
    """What a function gives for segments, remembered up to ``limit`` of them."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, segment: str):
        found = self.function(segment)
        if len(segment) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[segment] = found
        return found


@dataclass
class Vocabulary:
    """Pieces with scores; spaces stand for themselves."""

    score: dict[str, float | None]  # pieces, and with None prefixes of pieces
    ids: dict[str, int]
    bytes_: list[int]  # the id of each byte piece
    text: list[bytes]  # what each id decodes to
    unknown: float
    longest: int
    cut: np.ndarray = field(repr=False)  # (PLAIN, PLAIN) whether no piece holds the two characters in a row

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file. Piece kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
        pieces = []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    got = dict(_fields(value))
                    pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, 1)))
        return cls.build(pieces)

    @classmethod
    def build(cls, pieces: list[tuple[str, float, int]]) -> Vocabulary:
        normal = [s for _, s, k in pieces if k == 1]
        high, low = max(normal, default=0.0), min(normal, default=0.0)
        score, ids, raw_bytes, text = {}, {}, [0] * 256, []
        for i, (piece, s, kind) in enumerate(pieces):
            out = piece.replace("▁", " ")
            if kind == 6:
                raw_bytes[int(piece[3:5], 16)] = i
                text.append(bytes([int(piece[3:5], 16)]))
                continue
            text.append(out.encode() if kind in (1, 4) else b"")
            if kind in (1, 4):
                ids[out] = i
                score[out] = s if kind == 1 else len(out) * high - 0.1
        # Prefixes of pieces that are no pieces themselves have no score.
        table: dict[str, float | None] = {p[:k]: None for p in score for k in range(1, len(p))}
        table |= score
        cut = np.ones((PLAIN, PLAIN), dtype=bool)
        for p in score:
            for x, y in zip(p, p[1:], strict=False):
                if ord(x) < PLAIN and ord(y) < PLAIN:
                    cut[ord(x), ord(y)] = False
        return cls(table, ids, raw_bytes, text, low - 10, max((len(p) for p in score), default=1), cut)

    @cached_property
    def is_byte(self) -> np.ndarray:
        found = np.zeros(len(self.text), dtype=bool)
        found[self.bytes_] = bool(max(self.bytes_))
        return found

    @cached_property
    def singles(self) -> frozenset[str]:
        return frozenset(p for p, s in self.score.items() if s is not None and len(p) == 1)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, s in self.score.items():
            if s is not None:
                found.add_word(p, (len(p), s, self.ids[p]))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "singles", "is_byte", "memory", "scores")}

    def cuts(self, text: str) -> list[int]:
        """The places between characters of ``text`` that no piece crosses."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        a, b = codes[:-1], codes[1:]
        found = self.cut[np.minimum(a, PLAIN - 1), np.minimum(b, PLAIN - 1)] & (a < PLAIN) & (b < PLAIN)
        return (np.flatnonzero(found) + 1).tolist()

    def best(self, text: str, stop: int | None = None, entry: int = 0) -> tuple[list[float], list[int]]:
        """Best scores of covering ``text`` from ``entry`` to each place, and where the last piece starts.

        Pieces may start before ``stop`` only; places beyond it are states of the next chunk.
        """
        n = len(text)
        stop = n if stop is None else stop
        value, back = [NEVER] * (n + 1), [-1] * (n + 1)
        value[entry] = 0.0
        score, unknown, longest, none = self.score, self.unknown, self.longest, NEVER
        for i in range(entry, stop):
            v = value[i]
            if v == none:
                continue
            j, last = i + 1, min(i + longest, n)
            s = score.get(text[i:j], none)
            if s is none or s is None:
                if v + unknown > value[j]:
                    value[j], back[j] = v + unknown, i
                if s is none:
                    continue
            elif v + s > value[j]:
                value[j], back[j] = v + s, i
            while j < last:
                j += 1
                s = score.get(text[i:j], none)
                if s is None:
                    continue
                if s is none:
                    break
                if v + s > value[j]:
                    value[j], back[j] = v + s, i
        return value, back

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")]

    def trace(self, text: str, entry: int, end: int, stop: int | None = None) -> list[int]:
        """Ids of the best segmentation of ``text`` from ``entry`` to ``end``."""
        back = self.best(text, stop, entry)[1]
        pieces, at = [], end
        while at > entry:
            pieces.append(text[back[at] : at])
            at = back[at]
        return [i for p in reversed(pieces) for i in self.piece_ids(p)]

    def _fast(self, word: str) -> tuple[float, list[int]]:
        """``word`` for known characters only: an automaton yields the pieces by their ends, the longest first."""
        n = len(word) + 1
        value, back, via = [NEVER] * n, [0] * n, [0] * n
        value[0] = 0.0
        for end, (size, s, i) in self.automaton.iter(word):
            end += 1
            start = end - size
            v = value[start] + s
            if v > value[end]:
                value[end], back[end], via[end] = v, start, i
        out, at = [], n - 1
        while at:
            out.append(via[at])
            at = back[at]
        out.reverse()
        return value[-1], out

    def word(self, word: str) -> tuple[float, list[int]]:
        """Score and ids of a segment between cuts."""
        if self.singles.issuperset(word):
            return self._fast(word)
        value, back = self.best(word)
        pieces, at = [], len(word)
        while at > 0:
            pieces.append(word[back[at] : at])
            at = back[at]
        return value[-1], [i for p in reversed(pieces) for i in self.piece_ids(p)]

    @cached_property
    def memory(self) -> dict[str, list[int]]:
        return _Memory(lambda w: self.word(w)[1], REMEMBER)

    @cached_property
    def scores(self) -> dict[str, float]:
        return _Memory(lambda w: self.word(w)[0], SCORES)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, in one go."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.memory.__getitem__, self._segments(" " + text))))

    def _segments(self, text: str) -> list[str]:
        if not text:
            return []
        places = self.cuts(text)
        return [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]

    def decode_bytes(self, ids) -> bytes:
        """The bytes that ids stand for, with the leading space that encoding added."""
        text = self.text
        return b"".join([text[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")[1:] if len(ids) else ""

    def _middle(self, chunk: str, size: int) -> tuple[int, int]:
        """First and last cut of the chunk's first ``size`` characters, or (-1, -1)."""
        places = self.cuts(chunk[:size])
        return (places[0], places[-1]) if places else (-1, -1)

    def transfer(self, chunk: str, size: int) -> np.ndarray:
        """The (longest, longest) max-plus matrix of a chunk of ``size`` characters, given with its look-ahead."""
        m = np.full((self.longest, self.longest), NEVER)
        exits = min(self.longest, len(chunk) - size + 1)
        first, last = self._middle(chunk, size)
        if first < 0:
            for s in range(min(self.longest, size + 1)):
                m[s, :exits] = self.best(chunk, size, s)[0][size : size + exits]
            for s in range(size + 1, min(self.longest, len(chunk) + 1)):  # a piece that spans the whole chunk
                m[s, s - size] = 0.0
            return m
        middle = sum(self.scores[w] for w in self._segments(chunk[first:last]))
        tail = np.array(self.best(chunk[last:], size - last)[0][size - last : size - last + exits])
        for s in range(min(self.longest, first + 1)):
            m[s, :exits] = self.best(chunk[:first], None, s)[0][first] + middle + tail
        return m

    def entries(self, chunk: str, size: int, before: np.ndarray) -> list[int]:
        """For each exit state the entry state that tracing back from it ends in, given the best scores ``before`` of the entry states."""
        first, last = self._middle(chunk, size)
        head = chunk[:first] if first >= 0 else chunk
        stop = len(head) if first >= 0 else size
        reach, back = self._from_states(head, stop, before)

        def origin(at: int) -> int:
            while at >= 0 and back[at] >= 0:
                at = back[at]
            return at

        if first >= 0:
            s = origin(first) if reach[first] > NEVER else 0
            return [s] * self.longest
        out = []
        for t in range(self.longest):
            at = size + t
            out.append(origin(at) if at < len(reach) and reach[at] > NEVER else 0)
        return out

    def _from_states(self, text: str, stop: int, before: np.ndarray) -> tuple[list[float], list[int]]:
        """Like ``best`` from all entry states at once; ``back`` is -1 at the entry states."""
        n = len(text)
        value, back = [NEVER] * (n + 1), [-1] * (n + 1)
        for s in range(min(self.longest, n + 1)):
            value[s] = float(before[s])
        for i in range(min(stop, n)):
            if value[i] > NEVER:
                one, arrow = self.best(text[i : i + self.longest + 1], 1)
                for d in range(1, len(one)):
                    if one[d] > NEVER and value[i] + one[d] > value[i + d] and arrow[d] == 0:
                        value[i + d], back[i + d] = value[i] + one[d], i
        return value, back

    def between(self, chunk: str, size: int, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that start in the chunk, between its two states."""
        if entry >= size + leave:
            return []
        first, last = self._middle(chunk, size)
        if first < entry or first < 0:
            return self.trace(chunk, entry, size + leave, size)
        out = self.trace(chunk[:first], entry, first)
        for w in self._segments(chunk[first:last]):
            out += self.memory[w]
        return out + self.trace(chunk[last:], 0, size - last + leave, size - last)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All running max-plus products of a stack of matrices, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = max_plus(out[:-step].copy(), out[step:])
        step *= 2
    return out


def reach(matrices: np.ndarray) -> np.ndarray:
    """The best scores of each chunk's entry states, from state 0 of the first."""
    start = np.full((1, matrices.shape[1]), NEVER)
    start[0, 0] = 0.0
    return np.concatenate([start, scan(matrices)[:-1, 0]])


def compose(maps: list[list[int]]) -> list[int]:
    """The state at every border, from each chunk's map of exit to entry states; the last exit state is 0."""
    out = [0]
    for m in reversed(maps):
        out.append(m[out[-1]])
    return out[::-1]


def _digest_row(ids: list[int], v: Vocabulary) -> tuple[int, int, str, str]:
    packed = np.array(ids, dtype="<i4")
    text = v.decode_bytes(ids)[1:] if len(ids) else b""
    return len(ids), int(v.is_byte[packed].sum()), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(``id_col``, row, chunk, ids) of every document: one row (``row`` 0), or one for each chunk of a giant one (``row`` tells giants apart)."""
    return encode_small(docs, vocabulary, id_col, text_col, chunk).unionByName(encode_giant(docs, vocabulary, id_col, text_col, chunk))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _coded(docs: DataFrame, id_col: str) -> StructType:
    return StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("row long, chunk long, ids array<int>").fields])


def encode_small(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``encode`` of the documents below ``chunk`` characters."""
    base, v = _base(docs, id_col, text_col), vocabulary
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column("_text")):
                ids.append(np.array(v.encode(text.as_py()), dtype=np.int32))
                rows.append(k)
                if len(ids) == 256 or k == batch.num_rows - 1:
                    zero = pa.array(np.zeros(len(rows), np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("_id").slice(rows[0], len(rows)), zero, zero, pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "row", "chunk", "ids"])
                    ids, rows = [], []

    return base.where(F.length("_text") < chunk).mapInArrow(whole, _coded(docs, id_col))


def encode_giant(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``encode`` of the documents of ``chunk`` characters and more, by the parallel scan."""
    base, v, ahead = _base(docs, id_col, text_col), vocabulary, vocabulary.longest - 1
    # Giant texts: chunks with a look-ahead, of the text with its leading space.
    spaced = F.concat(F.lit(" "), F.col("_text"))
    giant = base.where(F.length("_text") >= chunk).withColumn("row", F.monotonically_increasing_id() + 1)
    number = F.ceil((F.length("_text") + 1) / chunk).cast("long")
    giant = giant.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    giant = giant.select("_id", "row", "chunk", F.least(F.length(spaced) - F.col("chunk") * chunk, F.lit(chunk)).cast("int").alias("size"), F.substring(spaced, (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk + ahead)).alias("part"))
    giant = settle(giant.repartition(partitions(docs.sparkSession), "row", "chunk"), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v.transfer(p, s).astype("<f8").tobytes() for p, s in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    def per_row(batches: Iterator[pa.RecordBatch], column: str, unpack, finish, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Gather ``column`` of each giant text's chunks, in order, and yield what ``finish`` makes of them."""
        key, stack = None, []

        def rows_of() -> pa.RecordBatch:
            k = len(stack)
            return pa.RecordBatch.from_arrays([pa.array([key] * k, pa.int64()), pa.array(range(k), pa.int64()), *finish(stack)], names=["row", "chunk", *names])

        for batch in batches:
            for row, x in zip(batch.column("row").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if row != key:
                    if stack:
                        yield rows_of()
                    key, stack = row, []
                stack.append(unpack(x))
        if stack:
            yield rows_of()

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda m: np.frombuffer(m, "<f8").reshape(v.longest, v.longest)
        finish = lambda stack: [pa.array([x.astype("<f8").tobytes() for x in reach(np.stack(stack))], pa.binary())]
        return per_row(batches, "matrix", unpack, finish, ["before"])

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v.entries(p, s, np.frombuffer(b, "<f8")) for p, s, b in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "before")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.list_(pa.int32()))], names=["row", "chunk", "origin"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(stack: list) -> list[pa.Array]:
            s = compose(stack)
            return [pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())]

        return per_row(batches, "origin", list, finish, ["entry", "leave"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(v.between(*x), dtype=np.int32) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("row"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "row", "chunk", "ids"])

    n = partitions(docs.sparkSession)
    found = giant.select("row", "chunk", "size", "part").mapInArrow(matrices, "row long, chunk long, matrix binary")
    found = found.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(reached, "row long, chunk long, before binary")
    found = giant.join(found, ["row", "chunk"]).select("row", "chunk", "part", "size", "before").mapInArrow(origins, "row long, chunk long, origin array<int>")
    found = found.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(borders, "row long, chunk long, entry int, leave int")
    return giant.join(found, ["row", "chunk"]).select("_id", "row", "chunk", "part", "size", "entry", "leave").mapInArrow(traced, _coded(docs, id_col))


def summarise(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Encode, decode and sum up: ``id_col``, n_tokens, n_byte_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256 of each document."""
    v = vocabulary
    out_type = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    names = [id_col, "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_digest_row(v.encode(x.as_py()), v) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=names)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, id_type = None, None, pa.int64()

        def row() -> pa.RecordBatch:
            i, n, b, h, d, _ = state
            return pa.RecordBatch.from_arrays([pa.array([i], id_type), pa.array([n]), pa.array([b]), pa.array([h.hexdigest()]), pa.array([d.hexdigest()])], names=names)

        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for i, r, ids in zip(batch.column(id_col).to_pylist(), batch.column("row").to_pylist(), batch.column("ids"), strict=True):
                if r != key:
                    if state:
                        yield row()
                    key, state = r, [i, 0, 0, hashlib.sha256(), hashlib.sha256(), True]
                packed = ids.values.to_numpy().astype("<i4")
                state[1] += len(packed)
                state[2] += int(v.is_byte[packed].sum())
                state[3].update(packed.tobytes())
                text = v.decode_bytes(packed)
                state[4].update(text[1:] if state[5] and len(text) else text)
                state[5] = state[5] and not len(text)
        if state:
            yield row()

    small = _base(docs, id_col, text_col).where(F.length("_text") < chunk).mapInArrow(one, out_type)
    giant = encode_giant(docs, v, id_col, text_col, chunk)
    return small.unionByName(giant.repartition(partitions(docs.sparkSession), "row").sortWithinPartitions("row", "chunk").mapInArrow(many, out_type))


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, text) of every document of ``encode``'s result."""
    v = vocabulary
    packed = encoded.groupBy(id_col, "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids")).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.decode(x.values.to_numpy()) for x in batch.column("ids")] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    return packed.mapInArrow(run, StructType([encoded.schema[id_col], *StructType.fromDDL("text string").fields]))
