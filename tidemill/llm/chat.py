"""Chat formatting with a finite-state machine over roles and a declarative template.

The machine walks a conversation's turns in order, checks each role's turn and emits text segments, each with a loss
flag. Control strings inside texts are escaped, reversibly.

Scale: one shuffle by conversation, then a sort inside partitions and a streaming pass: a task holds one turn at a time,
however long its conversation is. Reading back streams over the segments in the same partitions, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut

#: The control strings of the default template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """before/after: text around a turn's text, {role} standing for the role. loss: roles under the loss. follows: for each
    role (start: none so far) the roles that may come next."""

    before: str = OPEN + "{role}\n"
    after: str = CLOSE + "\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


SEGMENTS = "conv_id long, segment long, text string, loss boolean, valid boolean"
_schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])


def format_conversations(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv_id, segment, text, loss, valid) of all turns.

    Turns run by turn_col, then role and text (ties and repeated rows stay, each as its own turn). valid: the machine has accepted the
    conversation so far; turns after a fault are formatted all the same. Null texts and roles are empty; null ids form one conversation.
    Rows of one conversation come out together and in order. An empty table gives no segment.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, state, valid, n = object(), "start", True, 0
        for b in cut(batches, "text"):
            out = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, state, valid, n = c, "start", True, 0
                valid = valid and role in template.follows.get(state, ())
                state = role
                for part, loss in ((template.before.replace("{role}", escape_role(role)), False), (escape(text), role in template.loss), (template.after, False)):
                    out.append((c, n, part, loss, valid))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _schema)], schema=_schema)

    return placed.mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_digest = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


class _Reader:
    """Parses one conversation's formatted text, fed piece by piece."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.waiting, self.valid = "", True

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.waiting += text
        if not text.startswith(CLOSE):  # only template text starts so: texts are escaped
            return
        body, end, rest = self.waiting.partition(CLOSE + "\n")
        if end:
            role, _, said = body.removeprefix(OPEN).partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            self.waiting = rest

    def row(self):
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, parsed from the segments of format_conversations with the default template."""

    def run(batches):
        reader = None
        for b in cut(batches, "text"):
            out = []
            for c, text, loss, valid in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss", "valid"))):
                if reader is None or reader.conv != c:
                    if reader is not None:
                        out.append(reader.row())
                    reader = _Reader(c)
                reader.feed(text, loss, valid)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _digest)], schema=_digest)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(reader.row(), _digest)], schema=_digest)

    return segments.mapInArrow(run, DIGEST)
