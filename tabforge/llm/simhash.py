"""SimHash near-duplicates, linked exactly by covering locality-sensitive hashing.

A fingerprint has a bit set if more than half of the text's shingle hashes (XXH64, seed 42) have it.  Fingerprints at
most three bits apart are linked.  For that radius the 64 bit positions are dealt to the 15 nonzero vectors of four bits; the table of the
nonzero vector v keeps the positions whose vector has an odd product with v (about half).  Three differing
positions span at most three of four dimensions, so some v is orthogonal to all of them, and the pair agrees on all that this
table keeps: every pair within the radius meets in one of the 15 tables, none is missed.

Copies of a fingerprint are one node from the start.  A bucket of a table with up to ``BUCKET`` nodes gives a forest of
its links (fewer links than nodes, never all pairs).  A larger one is dealt anew by the same construction over the
positions that its table left out, and that once more: three levels fix 56 of the 64 bits or more, so a bucket
of the third level can't have over 256 nodes.  No bucket is cut off and none is gathered beyond that bound.

Texts that are null, empty or white space have fingerprint zero and are linked like others.  component_id is the smallest non-null
doc_id reachable (null if there is none); repeated rows have equal results; result columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import ship, whole
from tabforge.llm.components import components
from tabforge.session import cut_lineage

BUCKET, RADIUS, SHINGLE, SEED = 256, 3, 3, 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text; bytes.lower() and bytes.split() are exactly A-Z and the six ASCII spaces."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate([[0], ends[:n - 1]]).tolist()
    last = (ends[-n:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k:k + (1 << 16)], last[k:k + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the signed fingerprint of each whole text."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(whole(text)))


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions such that any ``radius`` of them are all outside some mask."""
    full = (1 << (radius + 1)) - 1
    given = [(p, k % full + 1) for k, p in enumerate(positions)]
    return [sum(1 << p for p, u in given if (u & v).bit_count() % 2) for v in range(1, full + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_levels() -> list[list[tuple[int, int]]]:
    """By level: (mask of the level above, mask) pairs; a deeper mask holds the one above it."""
    levels, above = [], [0]
    for _ in range(3):
        pairs = [(a, a | m) for a in above for m in covering([p for p in range(64) if not a >> p & 1])]
        levels.append(pairs)
        above = sorted({m for _, m in pairs})
    return levels


def _masks(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    """A fixed table of at most 15 ** 3 mask pairs."""
    return spark.createDataFrame([(signed(a), signed(m)) for a, m in sorted(set(pairs))], "above long, mask long")


def forest(fps) -> list[dict[str, int]]:
    """For a bucket of distinct fingerprints, a forest of links within the radius that spans each of its components."""
    x = np.sort(np.asarray(fps, np.int64))
    bits = x.view(np.uint64)  # bitwise_count takes a negative number's absolute value
    left, edges = np.ones(len(x), bool), []
    for k in range(len(x)):
        if not left[k]:
            continue
        left[k], frontier = False, [k]
        while frontier:
            at = frontier.pop()
            near = np.flatnonzero(left & (np.bitwise_count(bits ^ bits[at]) <= RADIUS))
            left[near] = False
            frontier += near.tolist()
            edges += [{"a": int(x[at]), "b": int(x[m])} for m in near]
    return edges


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints whose distances chain within the radius."""
    spark = nodes.sparkSession

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forests(buckets: pd.Series) -> pd.Series:
        return pd.Series([forest(fps) for fps in buckets], dtype=object)

    members = nodes.select(F.col(fp).alias("fp"))
    found = None
    for level, pairs in enumerate(mask_levels()):
        if level == 0:
            keyed = members.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for _, m in pairs])))
        else:
            keyed = members.join(F.broadcast(_masks(spark, pairs)), "above").drop("above").distinct()
        keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        counted = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = cut_lineage(keyed.join(counted, ["mask", "key"]))
        last = level == 2  # at most 2 ** 8 nodes differ in the positions that its tables leave out
        gathered = met.where((F.col("n") <= BUCKET) | F.lit(last)).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges = gathered.select(F.explode(forests("fps")).alias("e")).select("e.a", "e.b")
        found = edges if found is None else found.unionByName(edges)
        if last:
            break
        members = met.where(F.col("n") > BUCKET).select(F.col("mask").alias("above"), "fp").distinct()
        if members.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, fp (signed), fingerprint (16 hex digits), component_id, group_fp (smallest fingerprint)."""
    ship(docs.sparkSession)
    d = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    nodes = d.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = cut_lineage(components(links(nodes)))
    rooted = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = groups.withColumnRenamed("node", "fp").join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = rooted.join(of_root, "root", "left").select("fp", F.when(F.col("group_id").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("component_id"), F.col("root").alias("group_fp"))
    out = d.join(named, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of fingerprints: the smallest id's (null ids last); rows that share it, because ids clash, go by
    fingerprint and hashes of the text and of the row, so a repeated task chooses alike.  Of rows equal in all, any one."""
    ship(docs.sparkSession)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marks = {"_one_id": F.col(doc_id), "_one_text_a": F.xxhash64(whole(text)), "_one_text_b": F.xxhash64(F.lit(7), whole(text)), "_one_row": F.xxhash64(*hashed)}
    rows = fingerprints(docs.select(F.col(text).alias("_text"), *[c.alias(n) for n, c in marks.items()]), "_text", "fp")
    # one row a fingerprint before anything is joined: copies are summed up where they lie
    first = cut_lineage(rows.groupBy("fp").agg(F.min(F.struct(F.col("_one_id").isNull().alias("_none"), "_one_id", "fp", "_one_text_a", "_one_text_b", "_one_row")).alias("first")))
    groups = cut_lineage(components(links(first))).withColumnRenamed("node", "fp")
    chosen = first.join(groups, "fp", "left").groupBy(F.coalesce("root", "fp").alias("group_fp")).agg(F.min("first").alias("first"))
    chosen = chosen.select(*[F.col(f"first.{n}").alias(f"{n}_kept") for n in marks])
    same = [F.col(n).eqNullSafe(F.col(f"{n}_kept")) for n in marks]
    kept = docs.withColumns(marks).join(chosen, same, "left_semi")
    return kept.dropDuplicates(list(marks)).select(*docs.columns)
