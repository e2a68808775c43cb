"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. ``locate`` learns where each turn stands without looking
inside it: it renders successive prefixes of the conversation and compares each output with the one before. As long as the
earlier output is a prefix of the later one, the new turn's span is what was added; a probe in place of the turn's text tells
header from text. Where an earlier output is not a prefix of the next, the template rewrites history (it drops old
reasoning, moves the system turn, ...): that is recorded, and the turn is then located by a probe in the whole conversation
instead; a turn that cannot be found there has no span.

``TurnTemplate`` is the engine's own template. It marks each turn and escapes control strings inside roles and texts
reversibly with backslashes, so that no text can forge a mark; ``parse`` reads turns back from the output.

Cost: a conversation of n turns is rendered 2n times, from one turn to n. Rows of a conversation stream through one task in
turn order. Defined cases: a null text or role is empty; a null turn comes first; rows of equal turn are ordered by role and
text, repeated rows are turns each; rows of null conversation id form one conversation; an empty table gives the extra
conversations only; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import partitions, result_schema

Turn = tuple[str, str]  # role, text
PROBE = "\ue000probe\ue001"


class TurnTemplate:
    """``<|turn|>role`` line, text, ``<|end|>`` line for each turn."""

    OPEN, CLOSE = "<|turn|>", "<|end|>\n"
    CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    _escape = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROL)))
    _unescape = re.compile(r"\\(.)", re.S)

    def escape(self, text: str) -> str:
        """A backslash goes before each backslash and inside each control string, after its first character."""
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def __call__(self, turns: Sequence[Turn]) -> str:
        return "".join(f"{self.OPEN}{self._role(r)}\n{self.escape(t)}{self.CLOSE}" for r, t in turns)

    def _role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\\n")

    def parse(self, output: str) -> list[Turn]:
        """The turns that ``output`` was rendered from."""
        turns, at = [], 0
        while at < len(output):
            if not output.startswith(self.OPEN, at):
                raise ValueError(f"no turn at {at}")
            at += len(self.OPEN)
            line = at
            while output[line] != "\n":
                line += 2 if output[line] == "\\" else 1
            stop = output.index("<|end|>", line + 1)
            turns.append((self.unescape(output[at:line]), self.unescape(output[line + 1 : stop])))
            at = stop + len(self.CLOSE)
        return turns


@dataclass(frozen=True)
class Span:
    """A turn's place in the output: all of it, and its text as the template wrote it; -1 where it cannot be found."""

    start: int
    end: int
    text_start: int
    text_end: int


def locate(template: Callable[[Sequence[Turn]], str], turns: Sequence[Turn]) -> tuple[str, list[Span], int]:
    """The whole output, each turn's span in it, and how many times a further turn rewrote what stood before."""
    before, spans, rewrites = template([]) if turns else template(turns), [], 0
    ok, probe = True, probe_for(turns)
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        if output.startswith(before):
            probed = template([*turns[:k], (role, probe)])
            head = probed.find(probe, len(before))
            tail = len(probed) - head - len(probe)
            spans.append(Span(len(before), len(output), head, len(output) - tail) if head >= 0 else Span(len(before), len(output), -1, -1))
        else:
            rewrites, ok = rewrites + 1, False
            spans.append(Span(-1, -1, -1, -1))
        before = output
    if not ok:
        spans = [_by_probe(template, turns, k, before, probe) for k in range(len(turns))]
    return before, spans, rewrites


def probe_for(turns: Sequence[Turn]) -> str:
    """A text that stands in no role and no text of ``turns``."""
    said, probe, n = "\n".join(f"{role}\n{text}" for role, text in turns), PROBE, 0
    while probe in said:
        n += 1
        probe = f"{PROBE[:-1]}{n}{PROBE[-1]}"
    return probe


def _by_probe(template, turns: Sequence[Turn], k: int, output: str, probe: str) -> Span:
    probed = template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]])
    head = probed.find(probe)
    if head < 0 or probed.find(probe, head + 1) >= 0:
        return Span(-1, -1, -1, -1)
    tail = probed[head + len(probe) :]
    end = len(output) - len(tail)
    if end < head or output[:head] != probed[:head] or output[end:] != tail:
        return Span(-1, -1, -1, -1)
    return Span(head, end, head, end)


def format_conversations(
    rows: DataFrame, template: Callable[[Sequence[Turn]], str] | None = None, loss_roles: Sequence[str] = ("assistant",),
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_col``, output, spans, loss (spans of the text under the loss mask), n_turns, rewrites.

    ``spans`` has start, end, text_start and text_end of each turn, in code points of ``output``.
    """
    template = template or TurnTemplate()
    losing = frozenset(loss_roles)
    base = rows.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    base = base.repartition(partitions(rows.sparkSession), "_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    span = pa.struct([(k, pa.int64()) for k in ("start", "end", "text_start", "text_end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, size = None, [], [], 0
        conv_type = pa.int64()

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((conv_type, pa.string(), pa.list_(span), pa.list_(span), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["_conv", "output", "spans", "loss", "n_turns", "rewrites"])

        def finish() -> int:
            text, spans, rewrites = locate(template, turns)
            found = [{k: getattr(s, k) for k in ("start", "end", "text_start", "text_end")} for s in spans]
            loss = [f for f, (role, _) in zip(found, turns, strict=True) if role in losing and f["text_start"] >= 0]
            out.append((conv, text, found, loss, len(turns), rewrites))
            return len(text)

        started = False
        for batch in batches:
            conv_type = batch.schema.field("_conv").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("_conv", "_role", "_text")), strict=True):
                if started and c != conv:
                    size += finish()
                    turns = []
                    if size > 1 << 22:
                        yield batch_of()
                        size = 0
                conv, started = c, True
                turns.append((role, text))
        if started:
            finish()
            yield batch_of()

    spans = "array<struct<start: bigint, end: bigint, text_start: bigint, text_end: bigint>>"
    schema = result_schema(base.select("_conv").schema, f"output string, spans {spans}, loss {spans}, n_turns long, rewrites long")
    return base.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)


def digest(formatted: DataFrame, template: TurnTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites."""
    template = template or TurnTemplate()
    base = formatted.select(F.col(conv_col).alias("_conv"), "output", "loss", "rewrites")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for output, loss in zip(batch.column("output").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = template.parse(output)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                masked = "".join(template.unescape(output[s["text_start"] : s["text_end"]]) for s in loss)
                hexes = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, masked)]
                out.append((len(turns), hexes[0], len(masked), hexes[1], len(output)))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), *cols, batch.column("rewrites")], names=["_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    schema = result_schema(base.select("_conv").schema, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
    return base.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)
