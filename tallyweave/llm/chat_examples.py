r"""Chat training examples by prefix-target expansion, in DataFrame code alone.

Every assistant turn becomes one example: all turns before it are context, and only that
reply is trainable. A conversation that does not end with an assistant turn, or has none,
gives one more row without a trainable part, so that no turn is lost.

A turn is written ``<turn>role\ntext</turn>\n``. Inside roles and texts a backslash becomes
``\b`` and ``<`` becomes ``\l`` (in roles a line feed becomes ``\n``), so that no text can
hold a control string, and reading gives back the exact text.

An example holds its whole context by definition, so a conversation meets in one row; a
conversation of n turns gives text in proportion to n squared. That is what is asked for;
nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
REPLY_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    # Each backslash starts a pair; the one for a backslash itself goes last.
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def examples(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows to training rows.

    Result: ``conv_id, example`` (1, 2, ... in turn order), ``text`` (context and reply),
    ``loss_start, loss_end`` (code points of ``text``; equal: nothing is trained on) and
    ``whole`` (true on the row that holds all turns).

    Null roles and texts are empty, null turns come first, and equal turn numbers are
    ordered by role and text; repeated rows are repeated turns. A null conv_id is a
    conversation of its own. Empty tables give no rows; other columns are not read.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = F.transform("t", lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit("\n")))
    bodies = F.transform("t", lambda x: escape(x["text"]))
    parts = grouped.select("conv_id", heads.alias("heads"), bodies.alias("bodies"), F.transform("t", lambda x: x["role"] == REPLY_ROLE).alias("reply"))
    parts = parts.select("*", F.expr(f"transform(heads, (h, i) -> concat(h, bodies[i], '{CLOSE[:-1]}\\n'))").alias("turns"))
    # The places of replies, and the last place in any case.
    ends = F.expr("filter(sequence(1, size(reply)), i -> reply[i - 1] or i = size(reply))")
    placed = parts.select("*", F.posexplode(ends).alias("number", "k"))
    context = F.expr("concat(array_join(slice(turns, 1, k - 1), ''), heads[k - 1])")
    told = placed.select(
        "conv_id", (F.col("number") + 1).cast("bigint").alias("example"),
        context.alias("context"), F.expr("bodies[k - 1]").alias("body"),
        F.expr("reply[k - 1]").alias("trained"), F.expr("k = size(reply)").alias("whole"),
    )
    text = F.concat("context", "body", F.lit(CLOSE))
    start = F.when(F.col("trained"), F.length("context")).otherwise(F.length(text))
    return told.select(
        "conv_id", "example", text.alias("text"), start.cast("bigint").alias("loss_start"),
        F.when(F.col("trained"), F.length("context") + F.length("body")).otherwise(start).cast("bigint").alias("loss_end"), "whole",
    )


def read_turns(c: Column) -> Column:
    """Formatted text to ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(c, "</turn>\n"), lambda x: x != "")
    inner = F.transform(pieces, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))
    return F.transform(
        inner,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text"),
        ),
    )


def loss_text(text: str = "text") -> Column:
    """The trainable part of a row, as it was before formatting."""
    return unescape(F.substring(F.col(text), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))


def digests(written: DataFrame) -> DataFrame:
    """What the written examples hold, per conversation."""
    turns = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = written.select(
        "conv_id", "example", F.length("text").alias("chars"), loss_text().alias("loss"),
        F.when(F.col("whole"), turns).alias("turns"),
    ).select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"), F.sha2(F.array_join("turns", ""), 256).alias("sha"))
    grouped = rows.groupBy("conv_id").agg(
        F.max("n").cast("bigint").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"),
    )
    loss = grouped.withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return loss.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
