"""Chat formatting: a finite-state machine over roles, and a declarative template.

A template names its control strings, how a turn begins and ends, and which
roles' texts are under the loss. A conversation's turns, in order, become
segments (text, loss); their concatenation is the formatted text. Control
strings inside roles and texts are escaped: the escape mark is doubled, and put
after the first character of each control string, so that no control string is
left; both steps can be undone. The state machine reads the roles and tells
whether the turns come in an allowed order; conversations that fail are
formatted too, and flagged.

Values: a null role or text counts as empty; turns of equal number are ordered
by role and text; a null turn number comes first, a null conversation id is a
conversation of its own. A conversation is one row of output, so that its turns
come together in one task, as the digest of its text needs anyway. Of other
columns nothing is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>[INST] "
    after_role: str = " [/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; what isn't here is no allowed turn.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or self.escape in c or any(c[0] in d[1:] for d in self.controls):
                raise ValueError("a control string's first character must be in no control string but at its start")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column, t: Template) -> Column:
    doubled = _replace(text, t.escape, t.escape * 2)
    return reduce(lambda x, c: _replace(x, c, c[0] + t.escape + c[1:]), t.controls, doubled)


def unescaped(text: Column, t: Template) -> Column:
    plain = reduce(lambda x, c: _replace(x, c[0] + t.escape + c[1:], c), t.controls, text)
    return _replace(plain, t.escape * 2, t.escape)


def order_state(roles: Column, t: Template) -> Column:
    """The state after all roles; ``bad`` after a turn that isn't allowed."""
    moves = F.create_map(*(F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}\n{r}", to)))
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("bad")))


def format_chats(df: DataFrame, t: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: conv_id, n_turns, valid_order, formatted, segments (text, loss)."""
    t = t or Template()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("x"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.begin), escaped(x["role"], t), F.lit(t.after_role)), F.lit(False)),
                part(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
                part(F.lit(t.end), F.lit(False)),
            ),
        )
    )
    out = convs.withColumn("segments", segments)
    state = order_state(F.transform("turns", lambda x: x["role"]), t)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.accept).alias("valid_order"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column, t: Template | None = None) -> Column:
    """The turns (role, text) read back from a formatted text."""
    t = t or Template()
    pieces = F.split(formatted, "\\Q" + t.end + "\\E", -1)
    own = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing comes after the last end

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(t.begin) + 1), F.length(p))
        at = F.position(F.lit(t.after_role), body)
        return F.struct(unescaped(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescaped(F.substring(body, at + len(t.after_role), F.length(body)), t).alias("text"))

    return F.transform(own, turn)


def loss_text(segments: Column, t: Template | None = None) -> Column:
    """The text under the loss mask, unescaped, in order."""
    t = t or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
