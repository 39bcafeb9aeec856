"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, only its own text is trainable. A conversation that does not end with
an assistant turn also yields one last example without a target, so that its
trailing turns are not lost.

Template (each turn on its own):

    user       [INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant   text </s>
    other      [ROLE name] text [/ROLE]

Inside texts and role names `\\`, `<` and `[` are written `\\\\`, `\\l` and `\\b`,
in role names `]` is `\\c`.
So no control string can occur in a text, and what a reader finds between the
marks is unescaped to exactly the text that went in.

An example holds its whole context, that is what the method asks for; so one
row grows with its conversation, and a conversation of n assistant turns
yields n rows of it. Conversations are independent: they are the groups of the
only shuffle, and examples are generated one by one from a conversation's row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before and after a text, by role; fixed values of the template.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}
_OTHER = ("[ROLE ", "] ", " [/ROLE]")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


_ESCAPED = re.compile(r"\\(.)", re.S)
_MEANING = {"\\": "\\", "l": "<", "b": "[", "c": "]"}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANING[m[1]], text)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows of each conversation by turn, null texts and
    roles as empty ones. Rows with one turn number follow each other by role
    and text; rows without a conversation id form one conversation."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _marks(turn: Column) -> tuple[Column, Column]:
    role = turn["role"]
    name = F.replace(escape(role), F.lit("]"), F.lit("\\c"))
    before = F.concat(F.lit(_OTHER[0]), name, F.lit(_OTHER[1]))
    after = F.lit(_OTHER[2])
    for name, (left, right) in MARKS.items():
        before = F.when(role == name, F.lit(left)).otherwise(before)
        after = F.when(role == name, F.lit(right)).otherwise(after)
    return before, after


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length) of the rows of
    `conversations` (conv_id, turn, role, text): one row for each assistant
    turn, numbered from 0, and a last one with loss_length null if the
    conversation ends otherwise. loss_start and loss_length are code points of
    `formatted`: the escaped reply, without its marks."""

    def written(t: Column) -> Column:
        before, after = _marks(t)
        body = escape(t["text"])
        return F.struct(F.concat(before, body, after).alias("all"), F.length(before).alias("lead"), F.length(body).alias("size"), t["role"].alias("role"))

    parts = turns_of(conversations).select("conv_id", F.transform("turns", written).alias("parts"))
    spots = F.sequence(F.lit(1), F.size("parts"))
    targets = F.filter(spots, lambda i: (F.element_at("parts", i)["role"] == "assistant") | (i == F.size("parts")))
    rows = parts.select("conv_id", "parts", F.posexplode(targets).alias("example", "at"))
    last = F.element_at("parts", F.col("at"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("at") - 1), lambda p: p["all"]), "")
    rows = rows.select("conv_id", "example", context.alias("context"), last.alias("last"))
    reply = F.col("last.role") == "assistant"
    return rows.select(
        "conv_id", "example", F.concat("context", "last.all").alias("formatted"),
        F.when(reply, F.length("context") + F.col("last.lead")).alias("loss_start"),
        F.when(reply, F.col("last.size")).alias("loss_length"))


_TURN = re.compile(
    r"\[INST\] (?P<user>[^\[<]*) \[/INST\]|\[SYS\] (?P<system>[^\[<]*) \[/SYS\]"
    r"|\[ROLE (?P<name>[^\[<]*?)\] (?P<other>[^\[<]*) \[/ROLE\]| (?P<assistant>[^\[<]*) </s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m.lastgroup != "other" else unescape(m["name"])
        out.append((role, unescape(m[m.lastgroup])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars) of the rows of `examples`, from the formatted texts and
    loss masks alone. Turns come from each conversation's last example, which
    holds them all; trainable text from the mask of every example, in order."""
    loss = F.when(F.col("loss_length").isNotNull(), F.expr("substring(formatted, loss_start + 1, loss_length)"))
    own = formatted.select("conv_id", "example", loss.alias("loss"), F.length("formatted").cast("long").alias("n"), "formatted")
    parts = own.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("n").alias("formatted_chars"), F.max("example").alias("example"))
    # the last example by a join on its number: only that text of a conversation is kept
    whole = parts.alias("p").join(
        own.select(F.col("conv_id").alias("c"), F.col("example").alias("e"), "formatted"),
        F.col("p.conv_id").eqNullSafe(F.col("c")) & (F.col("p.example") == F.col("e")))
    rows = whole.select("conv_id", "formatted", F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, losses in zip(batch.column(1), batch.column(2)):
                turns = parse(text.as_py())
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(map(unescape, losses.as_py()))
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.string()), batch.column(3)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
