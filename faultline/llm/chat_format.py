"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads a conversation's turns in order, judges the turn order and emits text
segments with a loss flag each.  The template gives the text around each turn, the roles
whose text carries loss, and the moves that are legal; control strings inside roles and
texts are escaped reversibly, so that a formatted conversation always reads back as it was.

Turns of a conversation are brought together by one shuffle and sorted there; they then
stream through the machine one by one, so a task holds one turn at a time however long a
conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written.  ``opener`` + role + ``after_role`` + text + ``closer``."""

    opener: str = "<|im_start|>"
    after_role: str = "\n"
    closer: str = "<|im_end|>\n"
    #: Every control string begins with this; an escape inside it keeps texts from holding one.
    control: str = "<|"
    loss_roles: frozenset = frozenset({"assistant"})
    #: Legal next roles by state; a state is the last role, or "" at the start.
    moves: dict = field(default_factory=lambda: {
        "": {"system", "user"},
        "system": {"user"},
        "user": {"assistant"},
        "assistant": {"user", "tool"},
        "tool": {"assistant", "tool"},
    })
    #: States in which a conversation may end.
    final: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        """No result holds ``control``; a backslash stands before each character escaped."""
        first, rest = self.control[0], self.control[1:]
        return text.replace("\\", "\\\\").replace(self.control, f"{first}\\{rest}")

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


CHATML = Template()


def segments_of(template: Template, state: str, role: str, text: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, loss) of one turn."""
    yield "header", template.opener + template.escape_role(role) + template.after_role, False
    yield "text", template.escape(text), role in template.loss_roles
    yield "footer", template.closer, False


def format_chats(rows: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments ``conv_col, turn_index, segment, kind, text, loss, legal`` in order, where
    ``segment`` counts within the conversation and ``legal`` says whether the machine could
    move to the turn's role; at an illegal turn it goes on from that role.

    Rows are ordered by turn (null first), then role and text, so equal turns have a defined
    order and repeated rows are turns of their own.  Null roles and texts are empty, rows of
    a null conversation are one conversation.  An empty table gives no rows; other columns
    are not read.  Partitions hold whole conversations, sorted by conversation and turn.
    """
    kind = rows.schema[conv_col].dataType
    d = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    d = d.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    schema = f"{conv_col} {kind.simpleString()}, turn_index long, segment long, kind string, text string, " \
             "loss boolean, legal boolean"
    out = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)
        last, state, turn, n = object(), "", 0, 0
        for batch in batches:
            made = []
            for c, _, role, text in zip(*(col.to_pylist() for col in batch.columns)):
                if c != last:
                    last, state, turn, n = c, "", 0, 0
                legal = role in template.moves.get(state, ())
                for k, s, loss in segments_of(template, state, role, text):
                    made.append((c, turn, n, k, s, loss, legal))
                    n += 1
                state, turn = role, turn + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(zip(*made), arrow)] if made else
                [pa.array([], f.type) for f in arrow], schema=arrow)

    return d.mapInArrow(run, out)


class _Reader:
    """Digests of one conversation, read back from its segments."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.legal, self.state = True, ""

    def header(self, template: Template, text: str) -> None:
        role = template.unescape(text[len(template.opener):len(text) - len(template.after_role)])
        self.all.update(f"{role}\n".encode())
        self.turns, self.state = self.turns + 1, role

    def add(self, template: Template, kind: str, text: str, loss: bool, legal: bool) -> None:
        self.chars += len(text)
        self.legal &= legal
        plain = template.unescape(text) if kind == "text" else text
        if kind == "header":
            self.header(template, text)
        elif kind == "text":
            self.all.update(f"{plain}\n".encode())
        if loss:
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)


def read_chats(segments: DataFrame, template: Template = CHATML, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations say, unescaped: ``conv_col, n_turns, turns_sha256``
    (of role, newline, text, newline per turn), ``loss_chars, loss_sha256`` (all text under
    the loss flags), ``formatted_chars`` and ``valid`` (every turn legal, and a final state).

    ``segments`` as :func:`format_chats` gives them, in its order.  Streams: one segment and
    two running digests at a time."""
    kind = segments.schema[conv_col].dataType
    out = segments.sparkSession.createDataFrame(
        [], f"{conv_col} {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long, valid boolean").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)

        def closed(rs):
            v = [(r.conv, r.turns, r.all.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars,
                  r.legal and r.state in template.final) for r in rs]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in v], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

        open_ = None
        for batch in batches:
            done = []
            names = ("kind", "text", "loss", "legal")
            for c, *rest in zip(batch.column(conv_col).to_pylist(), *(batch.column(x).to_pylist() for x in names)):
                if open_ is None or c != open_.conv:
                    if open_ is not None:
                        done.append(open_)
                    open_ = _Reader(c)
                open_.add(template, *rest)
            yield closed(done)
        if open_ is not None:
            yield closed([open_])

    return segments.mapInArrow(run, out)


def formatted(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, text``: each conversation as one string, for conversations that fit a row."""
    s = F.sort_array(F.collect_list(F.struct("segment", "text")))
    return segments.groupBy(conv_col).agg(F.concat_ws("", F.transform(s, lambda x: x["text"])).alias("text"))


def parse(template: Template, text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    while text:
        if not text.startswith(template.opener):
            raise ValueError(f"no turn begins at {text[:40]!r}")
        role, _, rest = text[len(template.opener):].partition(template.after_role)
        body, _, text = rest.partition(template.closer)
        out.append((template.unescape(role), template.unescape(body)))
    return out
