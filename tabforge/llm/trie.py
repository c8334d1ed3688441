"""Conversation prefix trie by whole-sequence collapse.

A node is a distinct sequence of first turns.  Nothing is built turn by turn: identical conversations collapse into one weighted
sequence with the list of the conversations that end with it; only one conversation of each sequence, its smallest, goes on.  Its
turns' hashes, combined along it, name the nodes it passes, and grouped sums over the weighted sequences give each node's members
and smallest member.  Sequences that are a proper prefix of another drop out by an anti-join with the nodes that have children; what is
left are the leaves, whose prefixes, grouped, count the leaves below a node.

Sums over subtrees need no walk either.  A node belongs to the smallest leaf below it, so every leaf owns the end of its own
path from some depth on.  A node's subtree is all that its leaves own, less what its own leaf owns above it: a grouped sum and
a running sum.

A conversation may hold a third of all turns: running totals along one are taken in chunks of ``CHUNK`` places with
the totals of earlier chunks added, whole conversations are only ever grouped with partial sums, and joins on a conversation
or a parent (one root has many children) are left to Spark's skew handling.  A sequence that ends many conversations has
their ids joined in ranges of ``RANGE`` ids, which one digest reads as a stream; ids are never gathered as one value.

Turns are told apart by role and the MD5 of their text, places along a conversation by two 64-bit hashes combined by
exclusive or (each turn's hash depends on its place), so sequences that differ are kept apart by about 128 bits.

Defined cases: rows without a conversation id are left out; a null role or text is empty; a null turn comes first; turns of
one number are in order of role, then of the text's MD5, and rows alike are turns each; a conversation without turns ends
at the root; no conversations, no nodes.  Other columns than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import cut_lineage

CHUNK, RANGE = 1024, 4096
#: the contract's rebuilding: conversations share a head within groups of GROUP ids, of under HEADS turns
GROUP, HEADS = 5, 9
NODE = ["depth", "pa", "pb"]


def running(df: DataFrame, by: str, chunk: Column, order: list, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running totals (its own row included) along ``order`` within ``by``: name -> ('sum' or 'xor', value).
    ``chunk`` must rise with the order; a chunk is one window, and each ``by`` has one row a chunk in the window over chunks."""
    fold = {"sum": F.sum, "xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    df = df.withColumn("chunk", chunk)
    per = df.groupBy(by, "chunk").agg(*[fold[how](v).alias(f"of_{n}") for n, (how, v) in totals.items()])
    earlier = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(by, "chunk", *[fold[how](f"of_{n}").over(earlier).alias(f"of_{n}") for n, (how, _) in totals.items()])
    inside = Window.partitionBy(by, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({n: fold[how](v).over(inside) for n, (how, v) in totals.items()})
    out = local.join(before, [by, "chunk"])
    return out.withColumns({n: join[how](F.col(n), F.coalesce(f"of_{n}", F.lit(0))) for n, (how, _) in totals.items()}).drop(
        "chunk", *[f"of_{n}" for n in totals])


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), role, digest, n_bytes of each turn."""
    words = F.coalesce(F.col(text), F.lit(""))
    t = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.md5(words.cast("binary")).alias("digest"), F.octet_length(words).cast("long").alias("n_bytes"))
    first = F.coalesce(F.floor(F.col("turn") / F.lit(CHUNK)), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    return running(t, "conv", first, order, {"nth": ("sum", F.lit(1))}).select("conv", (F.col("nth") - 1).alias("pos"), "role", "digest", "n_bytes")


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the contract's rebuilding: the first h turns of conversation c - c % 5, then c's own
    turns after its first h, h being crc32 of c's decimal digits modulo 9."""
    c = t.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    c = c.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    of_base = c.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    c = cut_lineage(c.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    # at most GROUP conversations take a head's turns
    heads = c.select("base", F.col("conv").alias("to"), "h").join(t.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv", "base"), "base")
    heads = heads.where(F.col("pos") < F.col("h")).select(F.col("to").alias("conv"), "pos", "role", "digest", "n_bytes")
    own = t.join(c.select("conv", "h", "taken"), "conv").where(F.col("pos") >= F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "digest", "n_bytes")
    return c.select("conv"), heads.unionByName(own)


def digests(parts: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ends_sha256 of the texts of (key, chunk, ids), comma-joined in order of chunk; a key's texts go by one after
    the other."""
    types = dict(parts.dtypes)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for rows in batches:
            done = []
            for *k, ids in rows[[*key, "ids"]].itertuples(index=False, name=None):
                if k != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "ends_sha256"])

    dealt = parts.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids")
    return dealt.mapInPandas(stream, ", ".join(f"{k} {types[k]}" for k in key) + ", ends_sha256 string")


def prefix_trie(convs: DataFrame, t: DataFrame) -> DataFrame:
    """One row a node from conversations (conv) and their turns (conv, pos from 0 without gaps, role, digest, n_bytes):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    hashed = cut_lineage(t.select("conv", "pos", "n_bytes", F.xxhash64(F.lit(1), "pos", "role", "digest").alias("a"),
                                  F.xxhash64(F.lit(2), "digest", "role", "pos").alias("b")))
    whole = hashed.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("a").alias("pa"), F.bit_xor("b").alias("pb"))
    zero = {"depth": F.lit(0), "pa": F.lit(0), "pb": F.lit(0)}
    whole = convs.select("conv").join(whole, "conv", "left").select("conv", *[F.coalesce(c, zero[c]).cast("long").alias(c) for c in NODE])
    whole = cut_lineage(whole)
    sequences = cut_lineage(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")))

    # every sequence's prefixes, itself and the root included
    path = hashed.join(sequences.select("conv", "weight"), "conv")
    path = running(path, "conv", F.floor(F.col("pos") / F.lit(CHUNK)), ["pos"], {"pa": ("xor", F.col("a")), "pb": ("xor", F.col("b"))})
    path = path.select("conv", "weight", (F.col("pos") + 1).alias("depth"), "pa", "pb", F.col("pa").bitwiseXOR(F.col("a")).alias("qa"),
                       F.col("pb").bitwiseXOR(F.col("b")).alias("qb"), "n_bytes")
    root = sequences.select("conv", "weight", *[zero[c].cast("long").alias(c) for c in NODE], F.lit(None).cast("long").alias("qa"),
                            F.lit(None).cast("long").alias("qb"), F.lit(0).cast("long").alias("n_bytes"))
    path = cut_lineage(path.unionByName(root))

    nodes = cut_lineage(path.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("qa").alias("qa"),
                                                F.min("qb").alias("qb"), F.max("n_bytes").alias("n_bytes")))
    above = (F.col("depth") - 1).alias("depth")
    inner = nodes.where("depth > 0").groupBy(above, F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = cut_lineage(inner)
    leaves = sequences.join(inner, NODE, "left_anti").select("conv")
    along = cut_lineage(path.join(leaves, "conv").select("conv", *NODE))

    below = along.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_leaves"))
    known = nodes.join(below, NODE).join(inner, NODE, "left").withColumn("worth", (F.col("n_convs") - 1) * F.col("n_bytes"))
    known = running(known, "owner", F.floor(F.col("depth") / F.lit(CHUNK)), ["depth"], {"so_far": ("sum", F.col("worth"))})
    known = cut_lineage(known)
    owned = known.groupBy(F.col("owner").alias("conv")).agg(F.sum("worth").alias("owned"))
    subtree = along.join(owned, "conv").groupBy(*NODE).agg(F.sum("owned").alias("owned"))

    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    parts = whole.groupBy(*NODE, F.floor(F.col("conv") / F.lit(RANGE)).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    ends = digests(parts, NODE)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(subtree, NODE).join(ends, NODE, "left").join(parent, ["depth", "qa", "qb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                      (F.col("owned") - F.col("so_far") + F.col("worth")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
