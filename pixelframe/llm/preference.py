"""Preference pairs of conversations: one prompt, two masked completions.

chosen and rejected hold turns (pair, turn, role, text). The prompt is the longest common
prefix of turns: everything before the first turn number at which the two sides differ
(by role, text or presence). It is rendered once, from the chosen side; what follows on
each side is its completion, with a mask of the character ranges of assistant texts (and
their end marks), which are what a model learns from.

Turns are never gathered without bound: a result row covers `span` turn numbers of a
pair, so a conversation longer than that has several rows, numbered by segment, whose
texts continue each other; masks count characters from the row's own start.

Defined cases: a null text is empty, a null role is "user"; rows without a turn number
come first (as turn -1); equal rows of one side count once, different texts with one
turn number follow each other by role and text; a pair with one side only has an empty
prompt, and sides that never differ have empty completions. A null pair is a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 64
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def clean(turns: DataFrame, pair: str) -> DataFrame:
    return turns.select(
        F.col(pair).alias("pair"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def rendered(turns: Column) -> Column:
    """Turns as one text: mark, text, end mark, new line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END + "\n"))), "")


def masked(turns: Column) -> Column:
    """start:end ranges of assistant texts with their end marks in the rendered text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, t: Column) -> Column:
        first = a["at"] + F.length(head(t["role"]))
        last = first + F.length(t["text"]) + len(END)
        here = F.concat_ws(":", first.cast("string"), last.cast("string"))
        out = F.when(t["role"] == "assistant", F.concat(a["out"], F.array(here))).otherwise(a["out"])
        return F.struct((last + 1).alias("at"), out.alias("out"))

    return F.aggregate(turns, start, add, lambda a: F.array_join(a["out"], ","))


def preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", span: int = SPAN) -> DataFrame:
    """pair, segment, prompt, chosen, chosen_mask, rejected, rejected_mask, n_prompt_turns."""
    sides = clean(chosen, pair).withColumn("side", F.lit(1)).union(clean(rejected, pair).withColumn("side", F.lit(-1)))
    # equal turns cancel out: a turn number differs if its sums over both sides aren't zero
    mark = lambda seed: F.sum(F.xxhash64("role", "text", F.lit(seed)).cast("decimal(20,0)") * F.col("side"))
    per_turn = sides.groupBy("pair", "turn").agg(mark(1).alias("a"), mark(2).alias("b"), F.sum("side").alias("n"))
    first = per_turn.groupBy("pair").agg(F.min(F.when((F.col("a") != 0) | (F.col("b") != 0) | (F.col("n") != 0), F.col("turn"))).alias("fork"))
    known = sides.join(first.withColumnRenamed("pair", "_pair"), F.col("pair").eqNullSafe(F.col("_pair"))).drop("_pair")
    common = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    known = known.withColumn("part", F.when(common & (F.col("side") == 1), "prompt").when(~common & (F.col("side") == 1), "chosen").when(
        ~common, "rejected")).where("part is not null")
    turn = F.struct("turn", "role", "text")
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, turn)))
    rows = known.groupBy("pair", F.expr(f"turn div {span}").alias("segment")).agg(*[of(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    return rows.select(
        F.col("pair").alias(pair), "segment", rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen"), masked(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"), masked(F.col("rejected")).alias("rejected_mask"),
        F.size("prompt").cast("long").alias("n_prompt_turns"),
    )


def against_next(conversations: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: the chosen side is the conversation, on the rejected
    side the last assistant turn is the one of the next conversation (ascending key, after
    the last the first). Without an assistant turn both sides are the same."""
    from .common import with_next

    turns = conversations.select(F.col(key), "turn", "role", "text")
    last = turns.where(F.col("role") == "assistant").groupBy(key).agg(F.max("turn").alias("turn"))
    last = turns.where(F.col("role") == "assistant").join(last, [key, "turn"]).groupBy(key, "turn").agg(F.max("text").alias("answer"))
    swapped = with_next(last, key, F.col("turn"), ["answer"]).select(
        F.col(key).alias("_key"), F.col("turn").alias("_turn"), F.coalesce("next_answer", F.lit("")).alias("_answer"))
    joined = turns.join(swapped, F.col(key).eqNullSafe(F.col("_key")) & (F.col("turn") == F.col("_turn")) & (F.col("role") == "assistant"), "left")
    other = joined.select(key, "turn", "role", F.coalesce("_answer", "text").alias("text"))
    return turns, other
