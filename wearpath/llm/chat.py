"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags per segment.

A `Template` states the marks around a turn, the roles whose text is trained on, and the transitions of the
machine. `segments` emits three segments a turn (head, text, end), each with its loss flag; `formatted`
joins them per conversation and says whether the turn order is valid; `read_back` takes a formatted text
apart again.

Control strings inside texts and roles are escaped, reversibly: the characters the marks are recognised by
become two-character codes (see `ESCAPES`), so that neither ``### `` nor ``</turn>`` can occur inside a text.

Defined cases: rows order by turn (null first), then role and text, so ties have a fixed order; a null text or
role is empty; roles the machine does not know make the conversation invalid but are formatted all the same;
a conversation without rows does not appear; a null conversation id is one conversation. `segments` keeps
rows apart and shuffles for one window only; `formatted` gathers one conversation into one value, as its
result is one text per conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character and its code, in the order of escaping; the escape character is first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Template:
    head: str = "### "
    after_role: str = ": "
    end: str = "\n</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", "tool"),
        "tool": ("assistant",),
    })
    final: tuple[str, ...] = ("user", "assistant")


CHAT = Template()


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def final_state(roles: Column, template: Template) -> Column:
    """The state the machine ends in after an array of roles; ``error`` once a turn is out of order."""
    moves = F.create_map(*[F.lit(x) for state, nexts in template.transitions.items() for to in nexts for x in (f"{state}\n{to}", to)])
    return F.aggregate(roles, F.lit(template.start),
                       lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("error")))


def _turn_segments(turn: Column, template: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head = F.concat(F.lit(template.head), escape(turn["role"]), F.lit(template.after_role))
    return F.array(
        segment(head, F.lit(False)),
        segment(escape(turn["text"]), turn["role"].isin(*template.trained)),
        segment(F.lit(template.end), F.lit(False)),
    )


def _turns(conversations: DataFrame, by: str) -> DataFrame:
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("__turns"))


def formatted(conversations: DataFrame, by: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """(by, turn, role, text) -> per conversation: ``segments`` (text, loss), ``formatted``, ``valid``."""
    built = _turns(conversations, by).select(
        by, F.flatten(F.transform("__turns", lambda t: _turn_segments(t, template))).alias("segments"),
        final_state(F.transform("__turns", lambda t: t["role"]), template).isin(*template.final).alias("valid"))
    return built.select(by, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def segments(conversations: DataFrame, by: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """One row per segment: (by, position, text, loss). The long form of `formatted`, for writing out."""
    return formatted(conversations, by, template).select(by, F.posexplode("segments").alias("position", "s")).select(by, "position", "s.text", "s.loss")


def read_back(output: DataFrame, by: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """The turns (role, text) found in ``formatted`` and the unescaped text under the loss mask.

    A text holds no unescaped ``<`` and a role no unescaped ``:``, so the end mark and the first
    ``after_role`` of a turn can be searched for as plain strings.
    """
    cut = F.split(F.col("formatted"), rf"\Q{template.end}\E")
    bodies = F.slice(cut, 1, F.size(cut) - 1)  # behind the last end mark is nothing

    def parse(body: Column) -> Column:
        colon = F.instr(body, template.after_role)
        role = F.substr(body, F.lit(len(template.head) + 1), colon - len(template.head) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, colon + len(template.after_role))).alias("text"))

    return output.select(
        by, F.transform(bodies, parse).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss_text"),
        "formatted", "valid")


def digest(conversations: DataFrame, by: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """Counts and digests of what `read_back` finds in the formatted conversations."""
    found = read_back(formatted(conversations, by, template), by, template)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        by, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
