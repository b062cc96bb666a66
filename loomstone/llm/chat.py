"""Chat formatting by a finite-state machine over roles.

A template is data: for each role its opening and closing control string and
whether its text is trained on. Control strings that stand in a text are
escaped reversibly, so that a formatted conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings start with `[` or `<`, which stands nowhere else in them, and hold no backslash."""

    begin: str
    end: str
    roles: dict = field(hash=False)  # role: (open, close, trained)
    other: tuple  # for any other role: (open, between role and text, close)
    #: What may follow each state; the machine starts in "start".
    turns: dict = field(hash=False)


INSTRUCT = Template(
    begin="<s>",
    end="<end>",
    roles={"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[OUT]", "</s>", True)},
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    turns={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


class Formatter:
    """Turns to segments and back for one template."""

    def __init__(self, template: Template = INSTRUCT):
        self.template = template
        controls = {template.begin, template.end, *template.other, *(x for r in template.roles.values() for x in r[:2])}
        assert all(c[0] in "[<" and not re.search(r"[\[<\\]", c[1:]) and len(c) > 1 for c in controls)
        self.control = re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True))))
        self.special = re.compile(rf"\\|{self.control.pattern}")
        self.by_open = {v[0]: (k, v[1], v[2]) for k, v in template.roles.items()}

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts one after the first character of a control string."""
        return self.special.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(string, in the loss) for one turn."""
        if role in self.template.roles:
            open_, close, trained = self.template.roles[role]
            return [(open_, False), (self.escape(text), trained), (close, False)]
        open_, between, close = self.template.other
        return [(open_ + self.escape(role) + between, False), (self.escape(text), False), (close, False)]

    def step(self, state: str, role: str) -> str | None:
        """The machine's next state; None for a turn out of order, after which it stays there."""
        return role if role in self.template.turns.get(state, ()) else None

    def read(self, formatted: str):
        """(role, text, trained) of each turn of what segments() gave for whole turns."""
        at, n = 0, len(formatted)
        while at < n:
            m = self.control.match(formatted, at)
            if not m:
                raise ValueError("no control string where a turn should begin")
            at = m.end()
            if m[0] in (self.template.begin, self.template.end):
                continue
            role = None
            if m[0] == self.template.other[0]:
                m = self.control.search(formatted, at)
                if not m or m[0] != self.template.other[1]:
                    raise ValueError("role without text")
                role, close, trained = self.unescape(formatted[at : m.start()]), self.template.other[2], False
                at = m.end()
            else:
                role, close, trained = self.by_open[m[0]]
            m = self.control.search(formatted, at)
            if not m or m[0] != close:
                raise ValueError("turn not closed")
            yield role, self.unescape(formatted[at : m.start()]), trained
            at = m.end()


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SEGMENTS = "conv_id long, turn long, segment long, string string, in_loss boolean, in_order boolean"


def _format(template: Template):
    def run(batches):
        made, last, state, number = Formatter(template), (), None, 0

        def table(rows):
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            rows, size = [], 0
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv,) != last:
                    if last:
                        rows.append((last[0], None, number, template.end, False, state is not None))
                    last, state, number = (conv,), "start", 1
                    rows.append((conv, None, 0, template.begin, False, True))
                role, text = role or "", text or ""
                state = made.step(state, role) if state else None
                for string, trained in made.segments(role, text):
                    rows.append((conv, turn, number, string, trained, state is not None))
                    number += 1
                size += len(text)
                if size > 1 << 22:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)
        if last:
            yield table([(last[0], None, number, template.end, False, state is not None)])

    return run


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments (conv_id, turn, segment, string, in_loss, in_order) of all conversations, in order within partitions.

    Turns are ordered by turn, then role, then text, nulls first, so ties and
    repeated rows have a place; null roles and texts are empty strings; a
    role that the template lacks is written out beside its text. in_order is
    false from the first turn on that breaks the order of roles; such
    conversations are formatted nevertheless. Rows with a null conv_id form one
    conversation. Other columns are ignored; an empty table gives no rows. A
    conversation streams through its task row by row and is never held whole.
    """
    return _ordered(conversations).mapInArrow(_format(template), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def _digest(template: Template):
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        made, conv = Formatter(template), ()
        held: list[str] = []
        kept = None

        def flush():
            """Reads the turn that is whole by now."""
            for role, text, _ in made.read("".join(held)):
                kept["n"] += 1
                kept["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            held.clear()

        def row():
            flush()
            return (conv[0], kept["n"], kept["turns"].hexdigest(), kept["chars"], kept["loss"].hexdigest(), kept["size"], kept["ok"])

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        closers = {template.end, template.begin, template.other[2], *(v[1] for v in template.roles.values())}
        for batch in batches:
            rows = []
            for c, string, in_loss, ok in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "string", "in_loss", "in_order")), strict=True):
                if (c,) != conv:
                    if conv:
                        rows.append(row())
                    conv, kept = (c,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "ok": True}
                held.append(string)
                kept["size"] += len(string)
                if in_loss:
                    plain = made.unescape(string)
                    kept["chars"] += len(plain)
                    kept["loss"].update(plain.encode("utf-8", "surrogatepass"))
                kept["ok"] &= ok
                if string in closers:
                    flush()
            yield table(rows)
        if conv:
            yield table([row()])

    return run


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each conversation, from the strings and flags of format_chats() alone.

    The turns are parsed from the joined strings; loss_chars and loss_sha256
    come from the segments in the loss, unescaped.
    """
    return segments.mapInArrow(_digest(template), DIGEST)
