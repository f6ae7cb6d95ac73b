"""Chat formatting with typed content parts (operator 5), in DataFrame functions only.

A message is a list of parts: ``struct<type, text, ref, units>``. A visitor with one case per type
flattens the parts of a message, in order, into the text of its turn: text parts are escaped, image,
audio and document parts become placeholders. The attachments of a conversation are listed in the
order of their placeholders, each with its reference and the number of tokens its placeholder expands
to (``TOKENS_PER_UNIT`` times ``units``: image tiles, seconds of audio, document pages).

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In a text or role, ``<`` followed by any number of
backslashes and ``|`` gets one backslash more, so no control string can occur inside; taking one away
restores it. A line end in a role is written ``\\n`` and a backslash there twice.

Defined results: a NULL text, role or reference is empty; NULL parts and parts of another type vanish; a
NULL number of units counts as one. Rows are ordered by turn (NULL first), then role and parts, so that
repeated turns keep a fixed order; rows that repeat are repeated turns. Rows with a NULL conversation
id form one conversation. An empty table gives no conversations. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
LEARNED_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # A backslash pair stands for one; split on pairs first, so that "\\\\n" stays a backslash and an n.
    pieces = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def visit(part: Column) -> Column:
    """The text a part adds to its turn."""
    shown = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    return reduce(lambda c, kind: c.when(part["type"] == kind, F.lit(PLACEHOLDERS[kind])), PLACEHOLDERS, shown).otherwise(
        F.lit("")
    )


def expanded_tokens(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1).cast("bigint"))
    each = reduce(
        lambda c, kind: F.when(part["type"] == kind, F.lit(TOKENS_PER_UNIT[kind])).otherwise(c),
        TOKENS_PER_UNIT,
        F.lit(0),
    )
    return (each * units).cast("bigint")


def text_parts(text: Column) -> Column:
    """The parts of a message that is plain text."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("units"),
    )
    return F.array(part)


def format_chat(
    messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points, start
    from 0), attachments (position, type, ref, tokens) and expanded_tokens."""
    prepare(messages.sparkSession)
    cells = F.filter(F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            cells.alias("parts"),
        ).alias("message"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    head = lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
    flat = turns.select(
        "conv_id",
        F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"),
                head(m).alias("head"),
                F.array_join(F.transform(m["parts"], visit), "").alias("body"),
            ),
        ).alias("turns"),
        F.filter(F.flatten(F.transform("messages", lambda m: m["parts"])), lambda p: p["type"].isin(*PLACEHOLDERS)).alias(
            "attached"
        ),
    )
    sized = flat.withColumn(
        "formatted",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), ""),
    ).withColumn(
        # Running length before each turn, and the span of its body.
        "spans",
        F.aggregate(
            "turns",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda acc, t: F.struct(
                (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("at"),
                F.when(
                    t["role"] == LEARNED_ROLE,
                    F.concat(
                        acc["spans"],
                        F.array(
                            F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))
                        ),
                    ),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
        )["spans"],
    )
    return sized.select(
        "conv_id",
        "formatted",
        F.col("spans").alias("loss_spans"),
        F.transform(
            "attached",
            lambda p, i: F.struct(
                i.alias("position"),
                p["type"].alias("type"),
                F.coalesce(p["ref"], F.lit("")).alias("ref"),
                expanded_tokens(p).alias("tokens"),
            ),
        ).alias("attachments"),
        F.aggregate("attached", F.lit(0).cast("bigint"), lambda acc, p: acc + expanded_tokens(p)).alias("expanded_tokens"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Read turns and learned text back from ``formatted`` and ``loss_spans``.

    Adds ``turns`` (array of role and text) and ``learned`` (all text under the loss mask, unescaped).
    """
    # A start mark occurs nowhere but at the start of a turn, an end mark nowhere but at its end.
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(piece, at + 1, F.length(piece) - at - len(END) - 1)).alias("text"),
        )

    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn(
        "learned",
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
        ),
    )
