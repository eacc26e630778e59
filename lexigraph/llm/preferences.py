"""Preference formatting of chosen and rejected conversations.

The two conversations of a pair are compared turn by turn.  The turns of their
longest common prefix (same role and text) are rendered once as the prompt, and
what follows on each side is rendered as a completion.  A completion comes with
a mask: the spans of its characters, start inclusive and end exclusive, that a
loss should cover, which are the texts of assistant turns and their end marks.

All steps are DataFrame operations.  The common prefix is found by aggregation
over turns, not by collecting conversations; turns are gathered only to make
the text of one side of one pair, which is a row of the result.

Defined results: turns are ordered by (turn, role, text), nulls first, and are
compared by their place; a null role or text counts as empty.  A side without
turns has an empty completion; equal conversations are all prompt; a pair of
which a side is missing altogether keeps the other, with an empty prompt.  Rows
with a null pair id or side are dropped; repeated turns are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["piece"]), "")


def _mask(rows: Column) -> Column:
    """Spans (start, stop) of assistant texts with their end marks."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(state: Column, r: Column) -> Column:
        stop = state["at"] + F.length(r["piece"])
        head = F.lit(len(BEGIN) + 1) + F.length(r["role"])
        span = F.array(F.struct((state["at"] + head).cast("bigint").alias("start"), (stop - 1).cast("bigint").alias("stop")))
        return F.struct(stop.alias("at"), F.when(r["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(rows, start, step, lambda s: s["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of the rows ``pair_id, side ('chosen' or 'rejected'), turn, role, text``.

    Columns: ``pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.
    """
    clean = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = clean.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    turn = F.struct("role", "text")
    by_place = placed.groupBy("pair_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("side") == "chosen", turn)).alias("c"), F.max(F.when(F.col("side") == "rejected", turn)).alias("r")
    )
    same = (F.col("n") == 2) & (F.col("c") == F.col("r"))
    prefix = by_place.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("place"))), F.max("place") + 1).alias("first")
    )
    piece = F.struct("place", "role", _render(F.col("role"), F.col("text")).alias("piece"))
    parted = placed.join(prefix, "pair_id").select("pair_id", "side", "first", (F.col("place") < F.col("first")).alias("shared"), piece.alias("t"))

    def rows(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("t"))))

    gathered = parted.groupBy("pair_id").agg(
        (F.max("first") - 1).cast("bigint").alias("n_prompt_turns"),
        rows(F.col("shared") & (F.col("side") == "chosen")).alias("p"),
        rows(~F.col("shared") & (F.col("side") == "chosen")).alias("c"),
        rows(~F.col("shared") & (F.col("side") == "rejected")).alias("r"),
    )
    return gathered.select(
        "pair_id",
        "n_prompt_turns",
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations with an assistant turn.

    Chosen are the turns up to the last reply; rejected is the same with that
    reply replaced by an echo of the turn before it (empty, if it is the first).
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    own = Window.partitionBy("conv_id")
    ordered = own.orderBy("turn", "role", "text")
    numbered = rows.withColumn("place", F.row_number().over(ordered)).withColumn("before", F.coalesce(F.lag("text").over(ordered), F.lit("")))
    ending = numbered.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(own)).where("place <= last")
    sides = F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side")
    both = ending.select("*", sides)
    text = F.when((F.col("side") == "rejected") & (F.col("place") == F.col("last")), F.col("before")).otherwise(F.col("text"))
    return both.select(F.col("conv_id").alias("pair_id"), "side", F.col("place").alias("turn"), "role", text.alias("text"))
