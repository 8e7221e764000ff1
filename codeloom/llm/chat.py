"""Preference formatting, in DataFrame functions alone.

A chosen and a rejected conversation are arrays of turns. Their longest common prefix of turns is rendered
once, as the prompt; what is left of each is rendered as its completion, with a mask: the spans of
characters that a loss counts, which are the words of assistant turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import before

TRAINED = "assistant"
NO_ROLE = "unknown"
#: What stands before a turn's text (with its role between the two) and behind it.
BEGIN, MIDDLE, END, CLOSE = "<|im_start|>", "\n", "<|im_end|>", "\n"

TURNS = "array<struct<role:string,text:string>>"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END + CLOSE))), "")


def mask(turns: str) -> Column:
    """array<struct<start, end>>: code points of the rendered turns that are trained on. turns: SQL of an array of turns."""
    starts = before(f"transform(ts, t -> length(t.role) + length(t.text) + {len(BEGIN + MIDDLE + END + CLOSE)}L)")
    spans = f"zip_with(ts, {starts}, (t, at) -> named_struct('trained', t.role = '{TRAINED}', 'start', at + length(t.role) + {len(BEGIN + MIDDLE)}, 'end', at + length(t.role) + length(t.text) + {len(BEGIN + MIDDLE + END)}))"
    return F.expr(f"element_at(transform(array({turns}), ts -> transform(filter({spans}, s -> s.trained), s -> named_struct('start', s.start, 'end', s.end))), 1)")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns the two begin with alike."""
    alike = F.zip_with(chosen, rejected, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(alike, False), F.lit(0)) - 1, F.size(chosen)).cast("int")


def _clean(turns: Column) -> Column:
    whole = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit(NO_ROLE)).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.coalesce(whole, F.expr(f"cast(array() as {TURNS})"))


def preferences(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: arrays of role and text; other columns stay) formatted.

    Adds n_common, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask; replaces columns of
    these names. Masks count from the start of their completion. A null role is "unknown", null text
    empty, null conversations have no turns. Equal conversations have empty completions. No shuffle.
    """
    new = ("n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask")
    rows = pairs.drop(*new).withColumn("chosen", _clean(F.col("chosen"))).withColumn("rejected", _clean(F.col("rejected")))
    rows = rows.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.size(c))
    return rows.select("*", render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"), *[render(rest(c)).alias(f"{c}_text") for c in ("chosen", "rejected")], *[mask(f"slice({c}, n_common + 1, size({c}))").alias(f"{c}_mask") for c in ("chosen", "rejected")])


def paired(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected from a table of turns (conv_id, turn, role, text).

    No table says which of two answers is preferred, so the rejected side of a conversation is made:
    its turns before its last assistant turn, followed by its partner's turns from the partner's last
    assistant turn on. Conversations 2k and 2k + 1 are partners; without one, or without an assistant turn there, only
    the turns before remain. A conversation without an assistant turn keeps all its turns. Turns with one
    number are ordered by role and text. A turn without a conv_id is a conversation of its own, without a partner. An
    empty table gives no rows.

    One shuffle, by pair; a task holds one pair of conversations at a time, which are rows of the result.
    """
    pair = F.expr("shiftright(conv_id, 1)")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    both = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"), lone.alias("lone")).withColumn("pair", pair)
    both = both.groupBy("pair", "lone").agg(F.collect_list(F.struct("conv_id", "t")).alias("all"))
    own = lambda odd: F.transform(F.array_sort(F.filter("all", lambda x: F.coalesce(x["conv_id"].bitwiseAND(1), F.lit(0)) == odd)), lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text")))
    both = both.select("pair", own(0).alias("even"), own(1).alias("odd"))
    sides = F.array(F.struct(F.lit(0).alias("k"), F.col("even").alias("chosen"), F.col("odd").alias("other")), F.struct(F.lit(1).alias("k"), F.col("odd").alias("chosen"), F.col("even").alias("other")))
    rows = both.select("pair", F.inline(sides)).where(F.size("chosen") > 0)
    last = lambda c: F.expr(f"size({c}) - array_position(transform(reverse({c}), t -> t.role), '{TRAINED}') + 1")
    has = lambda c: F.expr(f"array_contains(transform({c}, t -> t.role), '{TRAINED}')")
    head = F.when(has("chosen"), F.slice("chosen", F.lit(1), (last("chosen") - 1).cast("int"))).otherwise(F.col("chosen"))
    tail = F.when(has("chosen") & has("other"), F.slice("other", last("other").cast("int"), F.size("other"))).otherwise(F.expr(f"cast(array() as {TURNS})"))
    return rows.select(F.expr("shiftleft(pair, 1) | k").alias("conv_id"), "chosen", F.concat(head, tail).alias("rejected"))


def spans_text(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.start, ':', s.end)), ',')")


def preference_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask of every conversation."""
    rows = preferences(paired(conversations))
    return rows.select("conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), spans_text("chosen_mask").alias("chosen_mask"), spans_text("rejected_mask").alias("rejected_mask"))
