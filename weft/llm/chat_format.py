"""Chat formatting by a finite-state machine over roles.

A declarative :class:`Template` names the markers of each role, whether its text bears
loss, and which role may follow which. Conversations are dealt by id and sorted, and a
single pass per partition walks the machine and emits, for each turn, one formatted
piece with its text segments and their loss flags; no conversation is held whole, so a
very long one streams. :func:`read_back` parses the pieces again.

Control strings inside a text are escaped reversibly: a run of k backslashes before a
control string becomes 2k+1 backslashes, a run before the end of the text 2k.

Defined results: a null text is empty, a null role is the role of no name; roles that
the template doesn't know are written with a generic marker that carries the role's
name; turns sort by (turn, role, text), nulls first; repeated rows are repeated turns;
rows of null conv_id form one conversation. An order of turns that the machine does
not allow marks the turn ``valid = false`` but is still written: nothing is dropped.
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
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]  # state: the roles it accepts; "" is the start
    other: Turn = Turn("[ROLE]", "[/ROLE]")  # holds the role's name, then the text after a marker
    name_end: str = "[/NAME]"
    extra: tuple[str, ...] = ()  # further control strings to escape
    _control: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        marks = {m for t in (*self.roles.values(), self.other) for m in (t.before, t.after)} | {self.name_end, *self.extra}
        if "" in marks:
            raise ValueError("markers can't be empty")
        if len({t.before for t in (*self.roles.values(), self.other)}) <= len(self.roles):
            raise ValueError("each role needs an opening marker of its own")
        for a in marks:
            for b in marks:
                if a != b and b.startswith(a) or "\\" in a:
                    raise ValueError(f"{a!r} begins another marker or holds a backslash")
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"the end of a text and {b!r} after it could read as {a!r}")
        object.__setattr__(self, "_control", re.compile("|".join(re.escape(m) for m in sorted(marks, key=lambda m: (-len(m), m)))))

    def escape(self, text: str) -> str:
        if "\\" not in text and not self._control.search(text):
            return text
        text = re.sub(r"(\\*)(" + self._control.pattern + ")", lambda m: m[1] * 2 + "\\" + m[2], text)
        n = len(text) - len(text.rstrip("\\"))
        return text + "\\" * n

    def write(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn, and whether each bears loss."""
        turn = self.roles.get(role)
        if turn is None:
            return [(self.other.before + self.escape(role) + self.name_end, False), (self.escape(text), False), (self.other.after, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def _until(self, s: str, at: int) -> tuple[str, str, int]:
        """Unescaped text up to the next control string that is not escaped, that string, and where it ends."""
        out = []
        while m := self._control.search(s, at):
            run = m.start() - at - len(s[at : m.start()].rstrip("\\"))
            out.append(s[at : m.start() - run] + "\\" * (run // 2))
            at = m.end()
            if run % 2 == 0:
                return "".join(out), m[0], at
            out.append(m[0])
        raise ValueError("a control string is missing")

    def read(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, loss) of each turn of a formatted string."""
        opens, at = {t.before: r for r, t in self.roles.items()}, 0
        while at < len(piece):
            head, mark, at = self._until(piece, at)
            if head:
                raise ValueError("text between turns")
            if mark == self.other.before:
                role, _, at = self._until(piece, at)
                text, _, at = self._until(piece, at)
                yield role, text, False
            else:
                text, _, at = self._until(piece, at)
                yield opens[mark], text, self.roles[opens[mark]].loss


#: System first if at all, then user and assistant in turn; only the assistant is learned.
INSTRUCT = Template(
    roles={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)

_PIECES = "conv_id long, seq long, formatted string, segments array<struct<text:string,loss:boolean>>, valid boolean"


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """rows: conv_id, turn, role, text. A row for each turn, in order within its partition."""
    narrow = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, seq, state = object(), 0, ""
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != conv:
                    conv, seq, state = c, 0, ""
                parts = template.write(role, text)
                made = (c, seq, "".join(p for p, _ in parts), [{"text": p, "loss": loss} for p, loss in parts], role in template.follows.get(state, ()))
                for o, x in zip(out, made, strict=True):
                    o.append(x)
                seq, state = seq + 1, role
            segment = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.list_(segment), pa.bool_()), strict=True)], names=["conv_id", "seq", "formatted", "segments", "valid"])

    return dealt.mapInArrow(run, _PIECES)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(pieces: DataFrame, template: Template = INSTRUCT, ordered: bool = True) -> DataFrame:
    """One row for each conversation, from the formatted pieces alone. ordered: the pieces lie
    as :func:`format_chats` left them, a conversation in one partition, in order; pieces that
    were stored and reread are dealt and sorted again without it."""
    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        conv, held = None, None
        for batch in batches:
            done = []
            for c, seq, piece, segments, valid in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if seq == 0:
                    if held:
                        done.append((conv, held))
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                for role, text, _ in template.read(piece):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = "".join(s["text"] for s in segments if s["loss"])
                if any(s["loss"] for s in segments):
                    closed = template._control.search(piece)[0] + masked + piece[len(piece) - len(segments[-1]["text"]) :]
                    plain = next(template.read(closed))[1]
                    held[2] += len(plain)
                    held[3].update(plain.encode("utf-8", "surrogatepass"))
                held[4] += len(piece)
                held[5] &= valid
            if done:
                yield rows(done)
        if held:
            yield rows([(conv, held)])

    def rows(done):
        made = [(c, h[0], h[1].hexdigest(), h[2], h[3].hexdigest(), h[4], h[5]) for c, h in done]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return pieces.mapInArrow(run, _DIGEST)
