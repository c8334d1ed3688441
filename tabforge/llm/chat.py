"""Preference formatting: the common start of a chosen and a rejected conversation once, and two masked completions.

Turns are compared position by position (role and text).  A pair's first difference splits both conversations: the turns
before it are rendered once as the prompt, the rest as the two completions.  A completion's loss mask lists the character
ranges [first, end) of what an assistant says in it, its end mark included; other turns and the headers are masked.

Both sides meet in one shuffle by pair and position, with equal plans on either side; the first difference is a grouped minimum
joined back, places are counted in chunks, and a conversation is gathered only to be rendered, which its own text (one output row) bounds.  Built-in functions only.

A conversation's turns are its distinct rows in order of (turn, role, text), numbered from 0, so repeated rows count once and ties have an order; null roles and
texts are empty, rows with a null conversation or turn are left out.  Equal conversations have empty
completions and ``trains`` false, as have pairs in which neither completion has an assistant's turn.  A pair with one side missing has
that side empty.  Other columns than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.trie import CHUNK, running

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """pair, pos, role, text from a table with a key, turn, role and text."""
    r = rows.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(
        F.col(key).alias("pair"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # places are counted in chunks of turn numbers, so a long conversation is no one task's window
    r = running(r, "pair", F.floor(F.col("turn") / F.lit(CHUNK)), ["turn", "role", "text"], {"nth": ("sum", F.lit(1))})
    return r.select("pair", (F.col("nth") - 1).cast("int").alias("pos"), "role", "text")


def _rendered(side: str) -> Column:
    return F.concat(F.lit(OPEN), F.col(f"{side}.role"), F.lit(MIDDLE), F.col(f"{side}.text"), F.lit(CLOSE))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair from two tables (pair, pos, role, text): n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask (arrays of [first, end)), trains."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("pair", "pos", F.struct("role", "text").alias(name))

    both = side(chosen, "c").join(side(rejected, "r"), ["pair", "pos"], "full")
    # the first difference is a grouped minimum, summed up before its shuffle
    split = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair").agg(F.min("pos").alias("split"))
    both = both.join(split, "pair", "left").withColumn("same", F.col("split").isNull() | (F.col("pos") < F.col("split")))

    def part(name: str, here: Column) -> Column:
        piece = F.struct("pos", _rendered(name).alias("s"), (F.col(f"{name}.role") == "assistant").alias("said"),
                         F.length(F.concat(F.lit(OPEN), F.col(f"{name}.role"), F.lit(MIDDLE))).alias("head"))
        return F.array_sort(F.collect_list(F.when(here & F.col(name).isNotNull(), piece)))

    g = both.groupBy("pair").agg(F.sum(F.col("same").cast("int")).cast("long").alias("n_common"), part("c", F.col("same")).alias("p"),
                                 part("c", ~F.col("same")).alias("c"), part("r", ~F.col("same")).alias("r"))

    def text(name: str) -> Column:
        return F.expr(f"array_join(transform({name}, x -> x.s), '')")

    def mask(name: str) -> Column:
        return F.expr(f"""filter(aggregate({name}, named_struct('n', 0, 'm', array(named_struct('first', -1, 'end', -1))),
            (a, x) -> named_struct('n', a.n + length(x.s), 'm', IF(x.said, array_append(a.m, named_struct('first', a.n + x.head, 'end', a.n + length(x.s) - 1)), a.m)),
            a -> a.m), x -> x.first >= 0)""")

    out = g.select("pair", "n_common", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
                   mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))
    return out.withColumn("trains", (F.size("chosen_mask") > 0) & (F.col("chosen") != F.col("rejected")))


def corrupted(t: DataFrame) -> DataFrame:
    """A rejected side for each conversation of ``t`` (pair, pos, role, text): its last assistant turn's text is replaced by its
    own opening turn's text (a reply that only echoes the prompt), and what follows is left out."""
    last = t.where("role = 'assistant'").groupBy("pair").agg(F.max("pos").alias("last"))
    first = t.where("pos = 0").select("pair", F.col("text").alias("echo"))
    j = t.join(last, "pair", "left").join(first, "pair")
    j = j.where(F.col("last").isNull() | (F.col("pos") <= F.col("last")))
    return j.select("pair", "pos", "role", F.when(F.col("pos") == F.col("last"), F.col("echo")).otherwise(F.col("text")).alias("text"))
