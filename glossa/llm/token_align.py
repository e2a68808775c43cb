"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens of one overlap which of the other.

A is a byte-level merge vocabulary (a ``tokenizers`` file), B a ``sentencepiece`` model; both read a space and the text, B adding the
space itself. The texts of an Arrow batch (in blocks of about ``BLOCK`` bytes) are one byte string with document offsets:

1. the string is cut into words where neither tokenizer can join across (``word_cuts``), and each distinct word is encoded once;
2. tokens of all words, in text order, give two lists of byte ends for the whole block; one ``bincount`` of each marks where A and B end;
3. where both end a group ends. Between two marks next to each other lie exactly one A and one B token, and each overlapping
   pair lies between exactly one pair of marks, so the marks are the links; running sums of the marks number tokens, groups and links
   and differences at document ends give each document's counts;
4. a block keeps its links by document and pair and sends its distinct pairs with their counts to the corpus-wide sum. What comes back for a
   block's pairs is summed over its documents' links by prefix sums again.

What travels is the distinct pairs of blocks, not links; a pair that every document holds is one row a block. Only a table of at most one row a
B id is broadcast, which the vocabulary bounds.

Defined cases: a null or empty text has no tokens, and neither has one whose A or B token bytes are not the text (U+2581, which B
writes for a space, is such); control strings in a text are text; a very long text is a block by itself, worked in whole, in about 40 times its
bytes of memory; of equal counts all are a B id's highest; repeated rows are aligned and counted each; ids may be null or of any type;
an empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from glossa.llm.common import raw, settle, string_blocks

BLOCK = 3 << 20
WORDS_A_CALL = 256


def word_cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in ``data``, and whether each may stand next to any other such word.

    A word starts at each text's start and at a single space between two characters of which neither is or may be white space (any byte up to
    0x20, or a lead byte that Unicode's wide spaces and U+2581 share). The latter are the plain words: no token of either vocabulary reaches across
    their ends, so they may be encoded side by side in any order.
    """
    n = len(data)
    lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    opens = (data > 0x20) & ~lead  # a character that may follow the space
    closes = data > 0x20
    closes[1:] &= ~lead[:-1]
    closes[2:] &= ~lead[:-2]
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (data[1:-1] == 0x20) & closes[:-2] & opens[2:]
    cut[starts] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], n)
    plain = (ends - at >= 2) & (data[at] == 0x20) & opens[np.minimum(at + 1, n - 1)] & closes[ends - 1]
    return at, plain


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``rows`` of a ragged array, one after the other, and their sizes."""
    size = np.diff(offsets)[rows]
    begin = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(offsets[rows] - begin, size)], size


@dataclass(frozen=True)
class Pair:
    """Two vocabularies by the contents of their files, which travel with the task."""

    a_file: str
    b_file: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def b_size(self) -> int:
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_file).get_piece_size()


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Tokens:
    """The byte strings of a vocabulary's ids, and their decimal texts."""

    def __init__(self, strings: list[bytes]):
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.diff(self.offsets)
        wide = max(len(str(len(strings))), 1) + 1
        text = np.array([str(i) for i in range(len(strings))], dtype=f"S{wide}").view(np.uint8).reshape(len(strings), wide)
        self.digits = text

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.offsets, ids)[0]


class Aligner:
    """Both tokenizers with their tables, loaded once a process."""

    def __init__(self, pair: Pair):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(pair.a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b_file)
        signs, names = _byte_of_sign(), json.loads(pair.a_file)
        a_strings = [b""] * self.a.get_vocab_size()
        for text, i in self.a.get_vocab().items():
            a_strings[i] = bytes(signs[c] for c in text) if all(c in signs for c in text) else text.encode()
        for added in names["added_tokens"]:
            a_strings[added["id"]] = added["content"].encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_strings = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_tokens, self.b_tokens = _Tokens(a_strings), _Tokens(b_strings)
        # A piece with a space after its first character (other than runs of spaces) could reach across words: then texts stay whole.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def _ids(self, texts: list[bytes], plain: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: the ids of all ``texts`` one after the other, each text's offset among them, and whether the bytes are the text's."""
        order = np.argsort(~plain, kind="stable")
        n_plain = int(plain.sum())
        calls = [order[k : min(k + WORDS_A_CALL, n_plain)] for k in range(0, n_plain, WORDS_A_CALL)] + [order[k : k + 1] for k in range(n_plain, len(order))]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        out = []
        for tokens, encode in (
            (self.a_tokens, lambda strings: [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]),
            (self.b_tokens, lambda strings: self.b.encode([s[1:] for s in strings], num_threads=1)),
        ):
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
            right = np.zeros(len(texts), dtype=bool)

            def place(call: np.ndarray, ids: np.ndarray, texts=texts, size=size, tokens=tokens, found=found, right=right) -> bool:
                """Deal the ids of joined texts out to them; False if they are not the texts' bytes."""
                if tokens.joined(ids).tobytes() != b"".join(texts[i] for i in call):
                    return False
                ends = np.searchsorted(np.cumsum(tokens.size[ids]), np.cumsum(size[call]), side="left") + 1
                for i, got in zip(call, np.split(ids, ends[:-1]), strict=True):
                    found[i], right[i] = got, True
                return True

            again = []
            for call, ids in zip(calls, encode(["".join(texts[i].decode() for i in call) for call in calls]), strict=True):
                if not place(call, np.array(ids, dtype=np.int64)) and len(call) > 1:
                    again += [call[k : k + 1] for k in range(len(call))]
            for call, ids in zip(again, encode([texts[c[0]].decode() for c in again]), strict=True):
                place(call, np.array(ids, dtype=np.int64))
            out.append((np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64), right))
        return out

    def align(self, texts: pa.Array) -> Aligned:
        """The alignment of a block of texts without nulls."""
        given = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        wide = pa.large_string()
        data, offsets = raw(pc.binary_join_element_wise(pa.scalar(" ", wide), texts.cast(wide), pa.scalar("", wide)))
        n = len(texts)
        at, plain = word_cuts(data, offsets[:-1])
        if not self.cuts:
            at, plain = offsets[:-1].copy(), np.zeros(n, dtype=bool)
        bounds = np.append(at, len(data)).astype(np.int64)
        # The words are the whole byte string: an Arrow array over it, without a copy, finds the distinct ones.
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = np.zeros(len(words.dictionary), dtype=bool)
        kinds[index] = plain
        (a_ids, a_off, a_right), (b_ids, b_off, b_right) = self._ids(words.dictionary.to_pylist(), kinds)
        first = np.searchsorted(at, offsets)
        wrong = np.concatenate(([0], np.cumsum(~(a_right & b_right)[index])))
        live = given & (wrong[first[1:]] == wrong[first[:-1]])
        used = index[np.repeat(live, np.diff(first))]
        length = np.where(live, np.diff(offsets), 0)
        a, _ = ragged(a_ids, a_off, used)
        b, _ = ragged(b_ids, b_off, used)
        return Aligned.of(a, b, self.a_tokens.size[a], self.b_tokens.size[b], np.concatenate(([0], np.cumsum(length))))


@dataclass
class Aligned:
    """A block's tokens, marks and per-document bounds (each n + 1 running counts)."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray  # whether each A token ends a group
    b_group: np.ndarray
    link_a: np.ndarray  # the A and B token of each link, in order
    link_b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    groups_at: np.ndarray
    links_at: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, offsets: np.ndarray) -> Aligned:
        total = int(offsets[-1])
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        marks = np.bincount(a_end, minlength=total + 1).astype(np.uint8) + 2 * np.bincount(b_end, minlength=total + 1).astype(np.uint8)
        place = np.flatnonzero(marks)
        kind = marks[place]
        a_mark, b_mark, both = kind & 1, kind >> 1, kind == 3
        number = lambda x: np.cumsum(x, dtype=np.int64) - x  # noqa: E731  how many tokens have ended before each mark
        running = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        at = np.searchsorted(place, offsets, side="right")
        return cls(
            a, b, marks[a_end] == 3, marks[b_end] == 3, number(a_mark), number(b_mark),
            running(a_mark)[at], running(b_mark)[at], running(both)[at], at,
        )

    def digests(self, a_tokens: _Tokens, b_tokens: _Tokens) -> list[str]:
        """Each document's groups as text, hashed: all tokens' digits and signs side by side in one matrix, the gaps left out."""
        n = len(self.a) + len(self.b)
        wide = max(a_tokens.digits.shape[1], b_tokens.digits.shape[1])
        rows = np.zeros((n, wide), dtype=np.uint8)
        before_a = np.cumsum(self.a_group) - self.a_group  # groups ended before each token
        before_b = np.cumsum(self.b_group) - self.b_group
        a_at = np.arange(len(self.a)) + np.concatenate(([0], np.flatnonzero(self.b_group) + 1))[before_a]
        b_at = np.arange(len(self.b)) + np.append(np.flatnonzero(self.a_group) + 1, len(self.a))[before_b]
        for tokens, ids, at, ends, sign in ((a_tokens, self.a, a_at, self.a_group, "|"), (b_tokens, self.b, b_at, self.b_group, ";")):
            digits = tokens.digits[ids]
            digits[np.arange(len(ids)), (digits != 0).sum(axis=1)] = np.where(ends, ord(sign), ord(",")).astype(np.uint8)
            rows[at, : digits.shape[1]] = digits
        shown = rows != 0
        size = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))
        text = memoryview(rows[shown].tobytes())
        ends = size[self.a_at + self.b_at]
        return [hashlib.sha256(text[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def pairs(self, b_vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (a * ``b_vocabulary`` + b) and their counts; by document the places of its pairs among them, their counts, and where each document's start."""
        code = self.a[self.link_a] * b_vocabulary + self.b[self.link_b]
        codes, local, n = np.unique(code, return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(self.links_at) - 1), np.diff(self.links_at))
        keys, times = np.unique(doc * max(len(codes), 1) + local, return_counts=True)
        owner, place = np.divmod(keys, max(len(codes), 1))
        return codes, n, place, times, np.searchsorted(owner, np.arange(len(self.links_at)))


@lru_cache(maxsize=2)
def _aligner(pair: Pair) -> Aligner:
    return Aligner(pair)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, byte planes apart and compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True) if n else b"", dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def blocks(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row a block: its documents' ids, counts and digests; its distinct pairs with counts; and, packed, which document holds which pair how often."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([
        *StructType.fromDDL("block long").fields, StructField("ids", ArrayType(id_type)),
        *StructType.fromDDL(", ".join(f"{c} array<long>" for c in _COUNTS) + ", digests array<string>, codes array<long>, n array<long>, first array<long>, place binary, times binary").fields,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(pair), TaskContext.get().partitionId() << 32
        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        for batch in batches:
            for start, stop, texts in string_blocks(batch, "_text", block_bytes):
                got = aligner.align(texts)
                codes, n, place, times, first = got.pairs(len(aligner.b_tokens.size))
                step = np.diff(place, prepend=0)
                step[first[:-1][first[:-1] < first[1:]]] = place[first[:-1][first[:-1] < first[1:]]]  # a document's first place is not told from the one before
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), listed(batch.column("_id").slice(start, stop - start), None), *(listed(np.diff(x), pa.int64()) for x in (got.a_at, got.b_at, got.groups_at, got.links_at)),
                        listed(got.digests(aligner.a_tokens, aligner.b_tokens), pa.string()), listed(codes, pa.int64()), listed(n, pa.int64()), listed(first, pa.int64()), pa.array([_packed(step)]), pa.array([_packed(times)]),
                    ],
                    schema=_arrow(schema, batch.schema.field("_id").type),
                )
                number += 1

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _arrow(schema: StructType, id_type: pa.DataType) -> pa.Schema:
    kinds = {"block": pa.int64(), "ids": pa.list_(id_type), "digests": pa.list_(pa.string()), "place": pa.binary(), "times": pa.binary()}
    return pa.schema([(f.name, kinds.get(f.name, pa.list_(pa.int64()))) for f in schema])


def pair_counts(found: DataFrame, b_vocabulary: int) -> DataFrame:
    """(code, total, best): how many links of the corpus hold each pair (a * ``b_vocabulary`` + b), and whether no other A id has more with its B id."""
    sent = found.select(F.explode(F.arrays_zip("codes", "n")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.n").alias("total"))
    sent = settle(sent, "align-pairs")
    # At most one row a B id: the vocabulary bounds what is broadcast.
    most = sent.groupBy((F.col("code") % b_vocabulary).alias("b")).agg(F.max("total").alias("most"))
    return sent.join(F.broadcast(most), F.col("code") % b_vocabulary == F.col("b")).select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    id_field = docs.schema[id_col]
    found = settle(blocks(docs, pair, id_col, text_col, block_bytes), "align-blocks")
    counts = pair_counts(found, pair.b_size)
    asked = found.select("block", F.explode("codes").alias("code"))
    told = asked.join(counts, "code").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "total", "best"))).alias("_told"))
    told = told.select("block", F.col("_told.total").alias("total"), F.col("_told.best").alias("best"))
    rows = found.drop("codes", "n").join(told, "block", "left")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = StructType([StructField(id_col, id_field.dataType), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda c: batch.column(c)[r].values  # noqa: B023, E731
                whole = lambda c: of(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                first, ids = whole("first"), of("ids")
                n = int(first[-1])
                step, times = (_unpacked(batch.column(c)[r].as_py(), n) for c in ("place", "times"))
                # Places were told as steps within each document: running sums less what had run up before it.
                run_up = np.concatenate(([0], np.cumsum(step)))
                place = run_up[1:] - np.repeat(run_up[first[:-1]], np.diff(first))
                told = n > 0
                total = whole("total")[place] * times if told else np.zeros(0, np.int64)
                best = whole("best").astype(np.int64)[place] * times if told else np.zeros(0, np.int64)
                by_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids, *(of(c) for c in _COUNTS), pa.array(by_doc(best)), pa.array(by_doc(total)), of("digests")], names=names)

    return rows.mapInArrow(finish, schema)
