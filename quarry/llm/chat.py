"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns stream through a task in order, conversation by conversation; nothing of
a conversation is held but its state, so one of any length has bounded memory.
Output is segments of text, each with a loss flag; joined in order they are the formatted conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import pick, shuffle_width


@dataclass(frozen=True)
class Template:
    """Text around each turn, roles whose text is trained on, and the roles that may follow each role (None: at the start)."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_end: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str | None, tuple[str, ...]], ...] = ((None, ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))

    def next_state(self, state: str | None, role: str) -> tuple[str | None, bool]:
        """(state after the turn, whether the order allows it). An unknown role keeps the state; an order that
        isn't allowed is flagged, not repaired, and the machine goes on from the new role."""
        order = dict(self.follows)
        return (role if role in order else state), role in order.get(state, ())

    def escape(self, text: str) -> str:
        """Put a backslash into control strings, and one more into those that have some, so that none is left."""
        return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<\\(\\*)\|", lambda m: "<" + m[1] + "|", text)

    def escape_role(self, role: str) -> str:
        """A role without control strings, and without newlines, at the first of which it ends."""
        return self.escape(role).replace("\\", "\\\\").replace("\n", "\\n")

    def unescape_role(self, role: str) -> str:
        return self.unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))

    def __post_init__(self):
        if not self.after_role.startswith("\n"):
            raise ValueError("a role must end at a newline, which escaping takes out of roles")
        if not all(s.startswith("<|") for s in (self.begin, self.end)):
            raise ValueError("control strings must begin with <|, which escaping breaks up")


def _ordered(turns: DataFrame, width: int) -> DataFrame:
    """Turns by conversation and turn; a conversation is in one task, as its order asks, but only streamed through it. Ties of turn go by role and text, null turns come first; a null conversation is one of its own."""
    plain = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, seq, segment, loss, valid) of rows (conv_id, turn, role, text); other columns are left out.

    Three segments a turn: what goes before the text, the text escaped, what
    goes after. loss is true for texts of trained roles only. valid says whether the
    turn may stand there. Null texts and roles count as empty; repeated rows are turns of their own. seq
    counts a conversation's segments from 0. No rows give no rows.
    """
    turns = pick(turns, "conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema if f.name in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, state, seq = None, False, None, 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("at", "seq", "segment", "loss", "valid")}
            for k, (c, role, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                if not started or c != conv:
                    conv, started, state, seq = c, True, None, 0
                state, valid = template.next_state(state, role)
                for segment, loss in ((template.begin + template.escape_role(role) + template.after_role, False), (template.escape(text), role in template.trained), (template.end + template.after_end, False)):
                    for name, v in (("at", k), ("seq", seq), ("segment", segment), ("loss", loss), ("valid", valid)):
                        out[name].append(v)
                    seq += 1
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(out["seq"], pa.int64()), pa.array(out["segment"], pa.string()), pa.array(out["loss"], pa.bool_()), pa.array(out["valid"], pa.bool_())],
                names=["conv_id", "turn", "seq", "segment", "loss", "valid"],
            )

    ordered = _ordered(turns, shuffle_width(turns.sparkSession))
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq bigint, segment string, loss boolean, valid boolean")


class _Reader:
    """Reads one conversation back from its segments as they come; holds at most one turn."""

    def __init__(self, template: Template):
        self.t, self.text, self.mask = template, "", []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: bool) -> None:
        t = self.t
        self.chars += len(segment)
        if loss:
            plain = t.unescape(segment)
            self.loss_chars += len(plain)
            self.trained.update(plain.encode("utf-8", "surrogatepass"))
        self.text += segment
        stop = t.end + t.after_end
        while (at := self.text.find(stop)) >= 0:
            turn, self.text = self.text[:at], self.text[at + len(stop) :]
            if not turn.startswith(t.begin):
                raise ValueError("a turn doesn't begin as the template says")
            role, _, text = turn[len(t.begin) :].partition(t.after_role)
            self.turns += 1
            self.all.update(f"{t.unescape_role(role)}\n{t.unescape(text)}\n".encode("utf-8", "surrogatepass"))


def read_back(segments: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """Per conversation, parsed from the joined segments: conv_id, n_turns, turns_sha256 (of role, newline, text,
    newline for each turn), loss_chars, loss_sha256 (of the unescaped text under the loss mask), formatted_chars.

    Segments may be null (empty) and loss too (false); a conversation of null id is one of its own. No rows give no rows; a text that isn't closed as the template
    says has no turn, and one that doesn't begin so raises ValueError.

    in_order: the segments come as ``format_chat`` leaves them, so no further shuffle or sort is needed.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = None

        def close(rows: list) -> None:
            if reader is not None:
                rows.append((conv, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.trained.hexdigest(), reader.chars))

        def made(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows: list = []
            for c, segment, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if reader is None or c != conv:
                    close(rows)
                    conv, reader = c, _Reader(template)
                reader.feed(segment or "", bool(loss))
            yield made(rows)
        if reader is not None:
            rows = []
            close(rows)
            yield made(rows)

    rows = segments if in_order else segments.repartition(shuffle_width(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.select("conv_id", "segment", "loss").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
