"""Chat formatting with Spark expressions only.

Template: each run of turns of one role becomes a block ``### Label: part</part>part</turn>\\n``. Label is User,
Assistant or System, or ``=role`` for any other role. Control strings can't occur in a text: every backslash of a
text becomes ``\\0``, and ``\\1`` parts ``##``, ``</turn>`` and ``</part>`` inside. Both are undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END_TURN, END_PART = "</turn>\n", "</part>"
ROLES = ("user", "assistant", "system")


def escaped(c: Column) -> Column:
    """A text in which no control string occurs."""
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    return F.regexp_replace(F.regexp_replace(c, "#(?=#)", "#\\\\1"), "<(?=/(?:turn|part)>)", "<\\\\1")


def unescaped(c: Column) -> Column:
    """The text that escaped() was given."""
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def label(role: Column) -> Column:
    """How a role reads in a header; no label holds a colon and a space."""
    own = F.concat(F.lit("="), F.regexp_replace(escaped(role), ":(?= )", ":\\\\1"))
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(own)


def role_of(lab: Column) -> Column:
    return F.when(lab.startswith("="), unescaped(F.substring(lab, 2, 2147483647))).otherwise(F.lower(lab))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text, loss), blocks (how many).

    Input: conv_id, turn, role, text. Turns go by turn, then role, then text, nulls first; equal rows are kept. Null
    texts and roles count as empty; a null conv_id is a conversation of its own; an empty table gives no rows; other
    columns are ignored. Adjacent turns of one role share a block. The segments joined are the formatted text; loss
    is true on assistant texts alone. A conversation's text is one string, so a conversation is bounded by a string.
    """
    t = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            turns["turn"].cast("long").alias("turn"),
            F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # where a run of one role starts, and where the next one does
    starts = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    runs = sorted_turns.withColumn("starts", starts).select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, i: F.slice("ts", s, F.coalesce(F.get("starts", i + 1), F.size("ts") + 1) - s),
        ).alias("runs"),
    )

    def block(run: Column) -> Column:
        role = run[0]["role"]
        last = F.size(run) - 1
        parts = F.transform(
            run,
            lambda t, i: F.array(
                F.struct(escaped(t["text"]).alias("text"), (role == "assistant").alias("loss")),
                F.struct(F.when(i == last, F.lit(END_TURN)).otherwise(F.lit(END_PART)).alias("text"), F.lit(False).alias("loss")),
            ),
        )
        head = F.struct(F.concat(F.lit("### "), label(role), F.lit(": ")).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(parts))

    out = runs.select("conv_id", F.size("runs").alias("blocks"), F.flatten(F.transform("runs", block)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "blocks")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The turns read back from the formatted text: conv_id, formatted, turns (array of role, text)."""
    pieces = F.filter(F.split("formatted", END_TURN, -1), lambda p: p != "")

    def turns(piece: Column) -> Column:
        lab = F.substring(F.substring_index(piece, ": ", 1), 5, 2147483647)
        body = F.substring(piece, F.length(lab) + 7, F.length(piece))
        return F.transform(F.split(body, END_PART, -1), lambda p: F.struct(role_of(lab).alias("role"), unescaped(p).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(pieces, turns)))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of what format_chats() wrote, read back from its output alone."""
    read = parse_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        learnt.alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
