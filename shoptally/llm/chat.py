"""Chat formatting (operator 9).

A declarative ``Template`` names the markers, the roles, which role may follow
which (a finite-state machine whose state is the last role) and which roles'
texts bear loss. ``format_chats`` orders a conversation's turns, runs the
machine over their roles, and emits the text segments with a loss flag each;
the segments laid end to end are the formatted string.

Control strings inside texts are escaped reversibly: a ``<`` followed by k > 0
bars gets k + 1 bars. The template's own markers have one bar, so an escaped
text never holds one, and dropping one bar restores the text. Roles are
escaped likewise, with line feeds as ``<|n`` (a marker has no such start).

``read_back`` parses the formatted string into turns and the loss segments
into texts, and is what the query derives its digests from.

Defined results: a NULL text or role is empty; turns are ordered by turn
(NULL first), then role, then text, so ties have one order; repeated rows are
repeated turns; NULL conversation ids form one conversation; a conversation
whose order the machine refuses is formatted all the same, with ``valid``
false and the position of the first refused turn in ``bad_turn``. One
conversation is one output string, so it is built in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for m in (self.start, self.end):
            if not (m.startswith("<|") and len(m) > 3 and m[2] not in "|n" and "<" not in m[1:]):
                raise ValueError(f"a marker starts with '<|' and a character other than '|' and 'n', and has no other '<': {m!r}")


TEMPLATE = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\|+)"), F.lit(r"<|$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\|(\|+)"), F.lit(r"<$1"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, F.lit(r"(?<!<\|)<\|n"), F.lit("\n")))


def _machine(turns: Column, t: Template) -> Column:
    """Struct (state, bad): the last role, and where the first turn came out of order."""
    step = F.create_map(*[F.lit(x) for a, bs in t.follows.items() for b in bs for x in (f"{a}\n{b}", b)])

    def move(acc: Column, e: Column) -> Column:
        to = F.try_element_at(step, F.concat(acc["state"], F.lit("\n"), e["role"]))
        bad = F.when(acc["bad"].isNotNull(), acc["bad"]).when(to.isNull(), acc["at"])
        return F.struct(F.when(bad.isNull(), to).otherwise(F.lit("")).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    init = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, init, move)


def format_chats(df: DataFrame, conv: Column, turn: Column, role: Column, text: Column, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>,
    formatted, valid, bad_turn."""
    t = template
    rows = df.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                                                     F.coalesce(text, F.lit("")).alias("text")).alias("e"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("turns"))
    loss = lambda e: e["role"].isin(*t.loss_roles) if t.loss_roles else F.lit(False)
    segment = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda e: F.array(
        segment(F.concat(F.lit(t.start), escape_role(e["role"]), F.lit("\n")), F.lit(False)),
        segment(escape(e["text"]), loss(e)),
        segment(F.lit(f"{t.end}\n"), F.lit(False)))))
    chats = chats.select("conv_id", segments.alias("segments"), _machine(F.col("turns"), t).alias("m"))
    ends = F.col("m")["state"].isin(*t.final) if t.final else F.lit(True)
    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        (F.col("m")["bad"].isNull() & ends).alias("valid"), F.col("m")["bad"].alias("bad_turn"))


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """From the output alone: conv_id, turns array<struct<role, text>> parsed
    from ``formatted``, losses array<string> from the segments under the mask."""
    t = template
    quote = lambda s: "\\Q" + s + "\\E"
    body = F.expr("substring(formatted, 1, length(formatted) - 1)")  # without the last line feed
    pieces = F.filter(F.split(body, quote(t.end) + r"(?:\n|\z)", -1), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.substr(p, F.lit(len(t.start) + 1)))
    turns = F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))
    losses = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select("conv_id", turns.alias("turns"), losses.alias("losses"), "formatted", "valid", "bad_turn")
