"""Preference formatting: what two conversations share becomes the prompt, the rest completions.

A pair has a chosen and a rejected conversation. The turns that both begin with, role and
text alike, are their longest common prefix and are rendered once. From the first turn that
differs on, each conversation is a completion; of it only the assistant's words are trained.
Everything is a row per rendered turn, so a conversation of any length never has to fit into
one task; ``assemble`` joins the rows of ordinary conversations to strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Marks around a turn. Inside a text their first two characters are parted.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
PARTS = ("prompt", "chosen", "rejected")


def alternate_pairs(conversations: DataFrame) -> DataFrame:
    """Each even conversation is the chosen one of a pair, the next odd one the rejected."""
    return conversations.withColumns(
        {"pair_id": F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 <> 0, 1, 0)"), "chosen": F.col("conv_id") % 2 == 0}
    )


def _other(conv_id: str) -> Column:
    """The conversation whose answer stands against this one's: even and next odd id belong together."""
    return F.expr(f"if(pmod({conv_id}, 2) = 0, {conv_id} + 1, {conv_id} - 1)")


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation up to its last answer, against the same turns with another answer.

    Rows (pair_id, chosen, turn, role, text), ``pair_id`` being the conversation's id. The
    answer is the assistant's turn with the largest number; the rejected side ends with that of
    the other conversation of ids 2k and 2k + 1 in its place. Conversations without an
    answer, and those whose other has none, give no pair; so do rows without an id.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", "text"
    )
    answered = F.col("role") == TRAINED_ROLE
    last = turns.where(answered).groupBy("conv_id").agg(F.max("turn").alias("answer"))
    # One row per conversation that has a pair.
    others = last.select(_other("conv_id").alias("pair_id"), F.col("conv_id").alias("other"), F.col("answer").alias("other_answer"))
    pairs = last.select(F.col("conv_id").alias("pair_id"), "answer").join(others, "pair_id")
    side = lambda df, chosen: df.select("pair_id", F.lit(chosen).alias("chosen"), "turn", "role", "text")
    own = turns.join(pairs, F.col("conv_id") == F.col("pair_id"))
    answers = turns.where(answered).join(pairs, (F.col("conv_id") == F.col("other")) & (F.col("turn") == F.col("other_answer")))
    return (
        side(own.where("turn <= answer"), True)
        .union(side(own.where("turn < answer"), False))
        .union(side(answers.withColumn("turn", F.col("answer")), False))
    )


def rendered(role: Column, text: Column) -> Column:
    part = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), part(role), F.lit("\n"), part(text), F.lit(CLOSE))


def preference_segments(turns: DataFrame) -> DataFrame:
    """Rendered turns: pair_id, part, turn, role, rendered, mask_start, mask_end.

    ``turns`` has pair_id, chosen (boolean), turn, role and text. ``part`` is prompt, chosen or
    rejected. Characters mask_start to mask_end (exclusive, code points) of ``rendered`` are
    trained: the text and the closing mark of an assistant's turn in a completion; elsewhere
    both are 0.

    A null turn counts as -1, null role and text as empty. Rows without a pair or a side are
    left out. Equal rows count once; several rows of one turn stand in order of role and text,
    and the turn is common if both conversations have the same rows there. Equal conversations
    are all prompt; a conversation without its counterpart is all completion. Empty tables
    give no rows.
    """
    clean = turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL").select(
        "pair_id",
        "chosen",
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The place of a row in its turn and its identity; texts themselves are not shuffled here.
    name = F.sha2("text", 256).alias("name")
    sides = clean.select("pair_id", "turn", "role", name, "chosen").groupBy("pair_id", "turn", "role", "name")
    sides = sides.agg(F.max("chosen").alias("left"), F.max(~F.col("chosen")).alias("right"))
    first = sides.where("NOT (left AND right)").groupBy(F.col("pair_id").alias("_pair"))
    first = first.agg(F.min("turn").alias("_differs"))
    # Hashing by text keeps a pair with very many turns spread.
    every = clean.withColumn("side", F.when(F.col("chosen"), "chosen").otherwise("rejected"))
    every = every.dropDuplicates(["pair_id", "side", "turn", "role", "text"])
    rows = every.join(first, F.col("pair_id") == F.col("_pair"), "left")
    common = F.col("_differs").isNull() | (F.col("turn") < F.col("_differs"))
    kept = rows.where(~common | F.col("chosen"))
    trained = ~common & (F.col("role") == TRAINED_ROLE)
    line = rendered(F.col("role"), F.col("text"))
    begin = F.length(rendered(F.col("role"), F.lit(""))) - len(CLOSE)
    return kept.select(
        "pair_id",
        F.when(common, "prompt").otherwise(F.col("side")).alias("part"),
        "turn",
        "role",
        line.alias("rendered"),
        F.when(trained, begin).otherwise(0).alias("mask_start"),
        F.when(trained, F.length(line)).otherwise(0).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """Per pair: prompt, chosen, rejected, and the trained spans of both completions.

    For conversations that fit into a row; segments are the form without that bound.
    """
    row = F.struct("turn", "role", "rendered", "mask_start", "mask_end")
    grouped = segments.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, row))).alias(f"_{p}") for p in PARTS]
    )
    text = lambda p: F.array_join(F.transform(f"_{p}", lambda s: s["rendered"]), "").alias(p)
    kind = "array<struct<start:int,end:int>>"

    def spans(p: str) -> Column:
        def step(state: Column, s: Column) -> Column:
            span = F.struct((state["at"] + s["mask_start"]).alias("start"), (state["at"] + s["mask_end"]).alias("end"))
            more = F.when(s["mask_end"] > 0, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct((state["at"] + F.length(s["rendered"])).alias("at"), more.alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
        return F.aggregate(f"_{p}", start, step, lambda s: s["spans"]).alias(f"{p}_spans")

    return grouped.select("pair_id", *[text(p) for p in PARTS], spans("chosen"), spans("rejected"))
