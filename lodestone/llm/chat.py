"""Chat formatting of preference pairs.

Each pair of a chosen and a rejected conversation is split at its longest common
prefix of turns.  The prefix is rendered once as the prompt; what follows on
either side is rendered as a completion with a mask that trains on the turns of
the assistant and on nothing else.  All turns of a pair meet in one shuffle, and
what follows is one expression a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is rendered as HEAD + role + MIDDLE + text + END.
HEAD, MIDDLE, END = "<|", "|>\n", "\n<|end|>\n"
#: The role whose text is trained on.
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _turn(*first: Column) -> Column:
    """A row as a struct that sorts by turn, a null one before all others, then by role and text."""
    at = F.col("turn").cast("long")
    return F.struct(*first, at.isNotNull().alias("known"), F.coalesce(at, F.lit(0).cast("long")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _listed(rows: Column) -> Column:
    """Such structs as an ordered array of (role, text)."""
    return F.transform(F.array_sort(rows), lambda y: F.struct(y["role"].alias("role"), y["text"].alias("text")))


def pair_turns(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id and the turns of both: ``chosen``, ``rejected``.

    ``pairs``: pair_id, chosen, rejected (conv_ids; pair_id is unique).  A side
    that is null or not in the table has no turns.  Nulls in role or text count
    as empty strings; repeated rows (all of conv_id, turn, role and text) count
    once; different rows of one turn follow by role and text, a null turn before
    all others.
    """
    rows = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.collect_set(_turn()).alias("x")).select("conv_id", _listed(F.col("x")).alias("turns"))
    sides = pairs.select("pair_id", F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"))
    for name in ("chosen", "rejected"):
        own = rows.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
        sides = sides.join(own, f"{name}_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    return sides.select("pair_id", "chosen_id", "rejected_id", *[F.coalesce(n, none).alias(n) for n in ("chosen", "rejected")])


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs out of neighbours 2n and 2n + 1, as ``pair_turns`` gives them.

    Conversation 2n is chosen.  The rejected side is the same conversation, with
    the last reply that its neighbour got in place of its own last reply, and
    ends there; a neighbour without a reply leaves it out.  If 2n is not in the
    table or has no reply, the neighbour itself is rejected.  Rows with a null
    conv_id belong to no pair; others count as ``pair_turns`` says.
    """
    odd = F.pmod(F.col("conv_id").cast("long"), F.lit(2))
    rows = conversations.where("conv_id IS NOT NULL").select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), "conv_id", _turn(odd.alias("odd")).alias("y"))
    side = lambda i: F.max(F.when(F.col("y.odd") == i, F.col("conv_id")))
    met = rows.groupBy("pair_id").agg(side(0).alias("chosen_id"), side(1).alias("rejected_id"), F.collect_set("y").alias("x"))
    own = met.select("pair_id", "chosen_id", "rejected_id", _listed(F.filter("x", lambda y: y["odd"] == 0)).alias("chosen"), _listed(F.filter("x", lambda y: y["odd"] == 1)).alias("other"))
    replies = F.filter("other", lambda y: y["role"] == TRAINED)
    # the number of turns up to the last reply, itself included; 0 without one
    last = F.coalesce(F.array_max(F.transform("chosen", lambda y, i: F.when(y["role"] == TRAINED, i + 1))), F.lit(0))
    swapped = F.concat(F.slice("chosen", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), F.slice(replies, F.greatest(F.size(replies), F.lit(1)), F.lit(1)))
    rejected = F.when(F.col("last") > 0, swapped).otherwise(F.col("other"))
    return own.withColumn("last", last).select("pair_id", "chosen_id", "rejected_id", "chosen", rejected.alias("rejected"))


def format_preferences(sides: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, two completions and two masks.

    ``sides``: pair_id, chosen_id, rejected_id, and the turns of both sides as
    arrays of (role, text).  The prompt holds the longest common prefix; equal
    turns later on don't count.  A side without turns gives an empty completion,
    and so do two equal sides.  A mask lists the code point spans ``start:end``
    of its completion that are trained on: text and end mark of the assistant's
    turns.  An empty table gives an empty result.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    split = sides.withColumn("n_prompt_turns", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
    n = F.col("n_prompt_turns")
    joined = lambda x: F.array_join(F.transform(x, _rendered), "")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    out = [joined(F.slice("chosen", F.lit(1), n)).alias("prompt")]
    for c in ("chosen", "rejected"):
        out += [joined(rest(c)).alias(c), _mask(rest(c)).alias(f"{c}_mask")]
    return split.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", *out)


def _mask(rest: Column) -> Column:
    """Spans of the trained turns of a list of turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, y: Column) -> Column:
        text_at = acc["at"] + F.lit(len(HEAD) + len(MIDDLE)) + F.length(y["role"])
        end = text_at + F.length(y["text"]) + F.lit(len(END))
        span = F.concat(text_at.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(y["role"] == TRAINED, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(rest, start, add, lambda acc: acc["spans"]), ",")
