"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame operations only.

The machine has one state for each role and one before the first turn: a turn moves it to the state of its role, if
the template lets that role follow the present state, and is a fault otherwise. Each state emits three segments:
the opening mark with the role, the text, and the closing mark; the template says which of them bear loss.

* ``format_turns`` emits the segments row by row: no text is shuffled.
* ``check_order`` runs the machine over (conversation, turn, role) alone. A long conversation is cut into chunks of
  turns; each chunk runs on its own and gives its first and last role and its first fault, and the chunks are then
  linked by one row each. So a conversation that holds a third of all rows is not one task's work.
* ``join_turns`` gathers the segments of each conversation where a whole conversation is wanted as one example.
* ``read_back`` parses turns out of formatted text again.

Texts and roles cannot forge a mark: a backslash is put before every backslash and behind the first character of every
control string, whether of this template or reserved by others, so that no control string stands in a
formatted text but as a mark. Taking each backslash away gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns of one chunk of a long conversation.
CHUNK_TURNS = 4096
#: The state before the first turn; a role of this name is not meant by it.
START = "start"


@dataclass(frozen=True)
class Role:
    """What a role may follow (other roles, or ``START``), and whether its text bears loss."""

    follows: tuple[str, ...]
    loss: bool = False
    may_end: bool = True


@dataclass(frozen=True)
class Template:
    """Marks around a turn, control strings to escape besides these, and the roles.

    The role stands between ``opening`` and the line end, the text between that and ``closing``. Roles that are not
    listed are formatted alike, bear no loss and are faults.
    """

    opening: str
    closing: str
    roles: dict[str, Role] = field(hash=False)
    reserved: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for c in self.controls():
            if len(c) < 2 or "\\" in c or any(c.endswith(c[:n]) for n in range(1, len(c))):
                raise ValueError(f"a control string has two characters or more, no backslash, and does not overlap itself: {c!r}")

    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.opening, self.closing, *self.reserved)))


# Marks of common chat formats.
CHATML = Template(
    opening="<|im_start|>",
    closing="<|im_end|>",
    reserved=("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
    roles={
        "system": Role(follows=(START,), may_end=False),
        "user": Role(follows=(START, "system", "assistant")),
        "assistant": Role(follows=("user",), loss=True),
    },
)


def _quote(text: str) -> str:
    """``text`` as a literal of a Java regex."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _literal(text: str) -> str:
    """``text`` as a replacement of a Java regex."""
    return re.sub(r"([\\$])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings; see the module's description."""
    rests: dict[str, list[str]] = {}
    for c in template.controls():
        rests.setdefault(c[0], []).append(_quote(c[1:]))
    places = [r"(?=\\)", *(rf"(?<={_quote(first)})(?={'|'.join(rest)})" for first, rest in rests.items())]
    return F.regexp_replace(text, "|".join(places), _literal("\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column, template: Template) -> Column:
    """A role on one line: line ends in it are escaped too."""
    return F.regexp_replace(escape(role, template), "\n", _literal("\\\n"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_turns(turns: DataFrame, template: Template = CHATML, *, role: str = "role", text: str = "text", segments: str = "segments") -> DataFrame:
    """Every row of ``turns`` with a column ``segments``: array of (text, loss), to be joined without a separator.

    Null texts and roles are formatted as empty ones. Repeated rows are turns like others, an empty table gives an
    empty result, and texts of any length are formatted whole. Other columns pass through; a column with the name
    given by ``segments`` is replaced.
    """
    name, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    loss = name.isin([r for r, rule in template.roles.items() if rule.loss])
    no = F.lit(False)
    opening = F.concat(F.lit(template.opening), _escaped_role(name, template), F.lit("\n"))
    emitted = F.array(_segment(opening, no), _segment(escape(body, template), loss), _segment(F.lit(template.closing + "\n"), no))
    return turns.withColumn(segments, emitted)


def check_order(turns: DataFrame, template: Template = CHATML, *, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, fault_turn, fault_role, last_role.

    A conversation is valid if each turn may follow the state before it and its last role may end one; the fault is
    the first turn that may not, or null. Turns go by number (nulls first) and, where numbers agree, by role.
    A null role is an empty one, and all rows with a null conversation form one conversation. Other columns are not
    used, so their names do not matter; an empty table gives an empty result.
    """
    named = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"))
    # Repeated rows meet here, combined before the shuffle; what follows has few rows for each turn.
    counted = named.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))
    chunked = counted.withColumn("chunk", F.floor(F.col("turn").cast("double") / CHUNK_TURNS))
    allowed = F.lit(False)
    for name, rule in template.roles.items():
        after = F.col("before").isin([r for r in rule.follows if r != START])
        after = F.when(F.col("before").isNull(), START in rule.follows).otherwise(after)
        allowed = allowed | ((F.col("role") == name) & after)
    twice = F.col("role").isin([name for name, rule in template.roles.items() if name in rule.follows])

    within = W.partitionBy("conv_id", "chunk").orderBy("turn", "role")
    stepped = chunked.withColumn("before", F.lag("role").over(within))
    fault = (F.col("before").isNotNull() & ~allowed) | ((F.col("n") > 1) & ~twice)
    at = F.struct("turn", "role")
    summary = stepped.groupBy("conv_id", "chunk").agg(
        F.sum("n").alias("n"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.min(F.when(fault, at)).alias("inner_fault"),
    )
    linked = summary.withColumn("before", F.lag("last.role").over(W.partitionBy("conv_id").orderBy("chunk"))).withColumn("role", F.col("first.role"))
    outer = F.when(~allowed, F.col("first"))
    found = linked.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.min(F.coalesce(outer, F.col("inner_fault"))).alias("fault"),
        F.max("last").alias("last"),
    )
    ends = F.col("last.role").isin([r for r, rule in template.roles.items() if rule.may_end])
    return found.select(
        "conv_id",
        "n_turns",
        (F.col("fault").isNull() & ends).alias("valid"),
        F.col("fault.turn").alias("fault_turn"),
        F.col("fault.role").alias("fault_role"),
        F.col("last.role").alias("last_role"),
    )


def join_turns(formatted: DataFrame, *, conv: str = "conv_id", turn: str = "turn", segments: str = "segments") -> DataFrame:
    """One row per conversation: conv_id and all its ``segments`` in the order of the turns.

    Turns go by number (nulls first) and, where numbers agree, by their segments. The conversation becomes one value,
    as an example of a training set is; where it need not be one, the rows of ``format_turns`` hold the same.
    """
    row = F.struct(F.col(turn).alias("turn"), F.col(segments).alias("segments"))
    grouped = formatted.select(F.col(conv).alias("conv_id"), row.alias("row")).groupBy("conv_id")
    ordered = F.sort_array(F.collect_list("row"))
    return grouped.agg(ordered.alias("rows")).select("conv_id", F.flatten(F.col("rows.segments")).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, template: Template = CHATML) -> Column:
    """``array<struct<role, text>>``: the turns of a formatted text."""
    turn = rf"(?s){_quote(template.opening)}([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*?){_quote(template.closing)}\n"
    roles, texts = (F.regexp_extract_all(text, F.lit(turn), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
