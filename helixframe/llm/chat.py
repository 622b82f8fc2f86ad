"""Chat formatting from a declarative template, in DataFrame functions only.

A template names, for each role, what stands before and after a turn's text and
whether the text is learned from.  A finite-state machine over the roles tells
whether the order of turns is valid.  Formatting emits segments (text, loss);
their concatenation is the formatted conversation.  Control strings inside texts
are escaped with a backslash behind their first character and backslashes are
doubled, so the markers stand nowhere but around turns and all is read back.

Defined results: a null text is empty; a null role is the empty role, and roles
that the template doesn't name get a marker with their name; turns of equal
number follow by role and text, null numbers first; rows of a null conversation
id are one conversation; an empty table gives no rows.  A conversation is one
output row, so it has to fit a task, with texts of any
length; equal rows are turns of their own.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, the marker of other roles, and the machine that checks the order."""

    turns: dict[str, Turn]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", "[/TURN]")
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=dict)
    ends: tuple[str, ...] = ()

    @property
    def control(self) -> list[str]:
        """The strings that are escaped inside texts."""
        marks = [m for t in self.turns.values() for m in (t.before, t.after)] + list(self.other)
        return sorted({m.strip() for m in marks} - {""}, key=lambda m: (-len(m), m))


INSTRUCT = Template(
    turns={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", "</s>", loss=True)},
    steps={
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    ends=("user", "assistant"),
)


def _escaped(text: Column, template: Template) -> Column:
    marks = "|".join(f"(?<={re.escape(m[0])}){re.escape(m[1:])}" for m in template.control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({marks})", r"\\$1")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _case(role: Column, template: Template, what, other: Column) -> Column:
    out = None
    for name, turn in template.turns.items():
        out = F.when(role == name, what(turn)) if out is None else out.when(role == name, what(turn))
    return out.otherwise(other)


def _segments(turn: Column, template: Template) -> Column:
    role, text = turn["role"], turn["text"]
    open_, close, end = template.other
    before = _case(role, template, lambda t: F.lit(t.before), F.concat(F.lit(open_), _escaped(role, template), F.lit(close)))
    after = _case(role, template, lambda t: F.lit(t.after), F.lit(end))
    loss = _case(role, template, lambda t: F.lit(t.loss), F.lit(False))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(segment(before, F.lit(False)), segment(_escaped(text, template), loss), segment(after, F.lit(False)))


def format_chats(
    turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per conversation: conv_id, valid (the machine accepts the order), segments (text, loss)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), then in template.steps.items() for x in (f"{state}\n{role}", then)])
    step = lambda state, t: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\n"), t["role"])), F.lit("invalid"))
    return chats.select(
        "conv_id",
        F.aggregate("turns", F.lit(template.start), step).isin(*template.ends).alias("valid"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    )


def formatted(chats: DataFrame) -> DataFrame:
    """``chats`` with text, the formatted conversation."""
    return chats.withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: _unescaped(s["text"])), "")


def parsed(text: str, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    open_, close, end = map(re.escape, template.other)
    before = "|".join(re.escape(t.before) for t in template.turns.values())
    after = "|".join(sorted({re.escape(t.after) for t in template.turns.values()} | {end}, key=len, reverse=True))
    pattern = F.lit(f"(?s)({before}|{open_}(.*?){close})(.*?)(?:{after})")
    part = lambda i: F.regexp_extract_all(text, pattern, F.lit(i))
    named = lambda mark, other: _role(mark, other, template)
    turns = F.arrays_zip(part(1).alias("mark"), part(2).alias("other"), part(3).alias("text"))
    return F.transform(turns, lambda t: F.struct(named(t["mark"], t["other"]).alias("role"), _unescaped(t["text"]).alias("text")))


def _role(mark: Column, other: Column, template: Template) -> Column:
    out = None
    for name, turn in template.turns.items():
        out = F.when(mark == turn.before, F.lit(name)) if out is None else out.when(mark == turn.before, F.lit(name))
    return out.otherwise(_unescaped(other))
