"""Preference pairs as training text: the shared turns once as prompt, then both completions with their loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.plans.shared import materialize

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    """One row for each (pair_id, turn): of repeated ones the smallest role and text; a null text is empty."""
    named = turns.where("pair_id is not null and turn is not null").select(
        F.col("pair_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.lower("role"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return named.groupBy("pair_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("pair_id", "turn", "x.role", "x.text")


def _safe(text: Column) -> Column:
    """Marks within a turn cannot pass for those around it."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, turn, role, piece, loss_start, loss_end: the turns of all pairs, rendered.

    Both sides are turns (pair_id, turn, role, text). A pair's prompt is its longest
    common prefix: the turns before the first that differs in role or text, or that one
    side lacks. It comes once (part ``prompt``); the rest comes as parts ``chosen`` and
    ``rejected``. ``piece`` is the rendered turn; a part's text is its pieces by turn,
    never gathered into one row. Loss falls on characters loss_start to loss_end of an
    assistant's piece in a completion (its text and the closing mark), and nowhere where
    both are null. Equal sides are all prompt. Rows without pair_id or turn are left out.
    """
    a, b = materialize(_turns(chosen), "chosen"), materialize(_turns(rejected), "rejected")
    both = a.withColumn("in_a", F.lit(True)).join(b.select("pair_id", "turn", F.col("role").alias("b_role"), F.col("text").alias("b_text"), F.lit(True).alias("in_b")), ["pair_id", "turn"], "full_outer")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & (F.col("role") == F.col("b_role")) & (F.col("text") == F.col("b_text"))
    first = materialize(both.where(~same).groupBy("pair_id").agg(F.min("turn").alias("first")), "first")
    marked = lambda x, part: x.join(first, "pair_id", "left").withColumn("part", F.when(F.col("first").isNull() | (F.col("turn") < F.col("first")), "prompt").otherwise(part))
    rows = marked(a, "chosen").unionByName(marked(b, "rejected").where("part = 'rejected'"))
    head = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"))
    piece = F.concat(head, _safe(F.col("text")), F.lit(CLOSE))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return rows.select(
        "pair_id", "part", "turn", "role", piece.alias("piece"),
        F.when(learned, F.length(head)).cast("long").alias("loss_start"), F.when(learned, F.length(piece) - 1).cast("long").alias("loss_end"),
    )


def with_foreign_reply(turns: DataFrame) -> DataFrame:
    """Rejected counterparts of conversations (conv_id, turn, role, text): each up to its last assistant turn, which
    is that of the conversation with the next conv_id instead (none if there is no such conversation or turn)."""
    named = turns.where("conv_id is not null and turn is not null").withColumn("role", F.lower("role"))
    reply = named.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.struct("turn", "text"))["text"].alias("reply"))
    reply = materialize(reply, "reply")
    before = named.join(reply.select("conv_id", "last"), "conv_id", "left").where("last is null or turn < last")
    swapped = reply.select("conv_id", "last").join(reply.select((F.col("conv_id") - 1).alias("conv_id"), "reply"), "conv_id")
    return before.select("conv_id", "turn", "role", "text").unionByName(
        swapped.select("conv_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))
    )
