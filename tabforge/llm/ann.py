"""Nearest neighbours by multi-index hashing of learned rotated binary codes, reranked on the vectors.

Fitting (on a bounded sample of ``SAMPLE`` vectors, the smallest hashes): the vectors are centred and two rotations are learned by
alternating between the sign codes and the orthogonal map that fits them best, so a vector has a code of twice its
dimension in bits.  How far apart codes of near vectors lie is then measured on ``PROBES`` of the queries against all rows: their
true neighbours' code distances follow a line in the vectors' distance, and ``COVER`` of them lie under the line that is used.
As a larger table has nearer neighbours, the radius shrinks with it.

Every row is indexed, once.  Rows are dealt by hash to blocks of at most about ``BLOCK_BYTES`` of vectors; a block's task builds the
index, one bucket table for each substring of about log2(rows) bits, and then reads the queries as a stream.  A query's radius rises:
with m substrings, the codes within m * a + j are those that agree with the query's up to a bits on one of the substrings 0 .. j or up to
a - 1 on another (pigeonhole), so each step flips a bits more in every table, by enumeration, and looks the
values up.  New rows whose whole code is near enough are reranked in double precision on the original vectors.  The search
ends when the radius reaches the line's value for the k-th distance found so far, or for the k-th distance of ``BOUND`` sampled rows,
whichever is less.  What blocks found meets in a ranking that keeps k rows a query before and after its shuffle.
Queries left with fewer than k rows, if any, are searched again without a bound on the radius.

The stated query set meets all rows in blocks; nothing is collected but the bounded samples.

Vectors that are null, empty, zero, or hold null or non-finite components, or whose length is not the table's most common one (of equally
common ones the smallest), and rows without an id take no part.  Every other row is a candidate of its own: rows with
the same id, even with the same vector, are found each, and a query id on several rows has a list for each of them.  Ties go to the smaller id.
Without vectors the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import ship
from tabforge.session import cut_lineage

SAMPLE, BOUND, PROBES, TURNS, COVER, BLOCK_BYTES, SPREAD, SEED = 6000, 1500, 64, 30, 0.97, 64 << 20, 8192, 3


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    turn: np.ndarray
    #: code distance that holds COVER of the pairs at a vector distance: slope * distance + offset
    slope: float = 0.0
    offset: float = math.inf

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn > 0

    def radius(self, distance: float) -> int:
        reach = self.slope * distance + self.offset if math.isfinite(distance) else math.inf
        return max(0, math.ceil(reach)) if reach < self.turn.shape[1] else self.turn.shape[1]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64)), np.uint64)
    raw = np.packbits(bits, axis=1, bitorder="little")
    out.view(np.uint8)[:, :raw.shape[1]] = raw
    return out


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learn(x: np.ndarray) -> Codes:
    """Centre and two learned rotations."""
    rng, d = np.random.default_rng(SEED), x.shape[1]
    mean = x.mean(axis=0)
    v, turns = x - mean, []
    for _ in range(2):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        turns.append(r)
    return Codes(mean, np.hstack(turns))


def under_line(codes: Codes, distance: np.ndarray, code_distance: np.ndarray) -> Codes:
    """``codes`` with the line that holds COVER of the measured pairs."""
    if not len(distance):
        return codes
    slope = 0.0
    if np.ptp(distance) > 0:
        slope = max(0.0, float(np.cov(distance, code_distance)[0, 1] / np.var(distance, ddof=1)))
    return Codes(codes.mean, codes.turn, slope, float(np.quantile(code_distance - slope * distance, COVER, method="higher")))


@lru_cache(maxsize=256)
def shell(width: int, flips: int) -> np.ndarray:
    """The values of so many bits of which ``flips`` are set."""
    every = np.arange(1 << width)
    return every[np.bitwise_count(every) == flips]


class Index:
    """A block of rows: per substring a table from its value to the rows that have it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.rows, self.x, self.codes = ids, rows, x, codes
        bits = codes.bits(x)
        self.code = packed(bits)
        width = min(20, max(8, round(math.log2(max(2, len(ids))))))
        self.parts = np.array_split(np.arange(bits.shape[1]), -(-bits.shape[1] // width))
        self.tables = []
        for part in self.parts:
            value = self.values(bits, part)
            start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << len(part)))])
            self.tables.append((start, np.argsort(value, kind="stable")))
        self.met, self.turn = np.zeros(len(ids), np.int64), 0
        self.probed = 0

    @staticmethod
    def values(bits: np.ndarray, part: np.ndarray) -> np.ndarray:
        return bits[:, part] @ (1 << np.arange(len(part)))

    def bucket_rows(self, table: int, value: int, flips: int) -> np.ndarray:
        """Rows whose substring differs from ``value`` in just so many bits."""
        start, order = self.tables[table]
        at = shell(len(self.parts[table]), flips) ^ value
        low, n = start[at], start[at + 1] - start[at]
        full = np.flatnonzero(n)
        low, n = low[full], n[full]
        return order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def shells(self, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Radius after radius the rows not met before; all rows within the radius have been given then."""
        value = [int(self.values(bits[None], part)[0]) for part in self.parts]
        m = len(self.parts)
        self.turn += 1
        for radius in range(bits.size + 1):
            flips, table = divmod(radius, m)
            found = self.bucket_rows(table, value[table], flips) if flips <= len(self.parts[table]) else np.zeros(0, np.int64)
            found = found[self.met[found] != self.turn]
            self.met[found] = self.turn
            self.probed += len(found)
            yield radius, found

    def nearest(self, own: int, v: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the block, distances) of the k nearest retrieved rows but the query's own, nearest first."""
        bits = self.codes.bits(v[None])[0]
        code = packed(bits[None])[0]
        best, dist = np.zeros(0, np.int64), np.zeros(0)
        reach = self.codes.radius(bound)
        waiting: list[np.ndarray] = []
        m = len(self.parts)
        for radius, found in self.shells(bits):
            waiting.append(found)
            if radius < reach and (radius + 1) % m:
                continue
            found = np.concatenate(waiting)
            waiting = []
            found = found[(apart(self.code[found], code) <= reach) & (self.rows[found] != own)]
            if len(found):
                near = np.sqrt(((self.x[found].astype(np.float64) - v) ** 2).sum(axis=1))
                best, dist = np.concatenate([best, found]), np.concatenate([dist, near])
                by = np.lexsort((self.rows[best], self.ids[best], dist))[:k]
                best, dist = best[by], dist[by]
                if len(dist) == k:
                    reach = min(reach, self.codes.radius(min(bound, dist[-1])))
            if radius >= reach:
                break
        return best, dist


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, v) of the rows that take part; ``row`` tells them apart."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(v, lambda c: c != 0)
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    ok = rows.where(F.col(key).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("v"))
    return cut_lineage(ok.select(F.monotonically_increasing_id().alias("row"), "id", "v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def calibrated(codes: Codes, ok: DataFrame, probes: list, k: int) -> Codes:
    """``codes`` with the line measured on a few queries (row, v) against all rows."""
    own, q = np.array([r["row"] for r in probes]), np.array([r["v"] for r in probes], float)
    code, d = packed(codes.bits(q)), q.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for b in batches:
            rows, x = b.column("row").to_numpy(), matrix(b.column("v"), d).astype(float)
            c = packed(codes.bits(x))
            for j in range(len(q)):
                dist = np.sqrt(((x - q[j]) ** 2).sum(axis=1))
                dist[rows == own[j]] = np.inf
                near = np.argsort(dist, kind="stable")[:k]
                near = near[np.isfinite(dist[near])]
                dist, far = np.concatenate([kept[j][0], dist[near]]), np.concatenate([kept[j][1], apart(c[near], code[j])])
                by = np.argsort(dist, kind="stable")[:k]
                kept[j] = dist[by], far[by]
        yield pa.RecordBatch.from_pydict({"j": np.repeat(np.arange(len(q)), [len(x) for x, _ in kept]),
                                          "dist": np.concatenate([x for x, _ in kept]), "far": np.concatenate([x for _, x in kept])})

    found = ok.select("row", "v").mapInArrow(measure, "j long, dist double, far long")
    nearest = Window.partitionBy("j").orderBy("dist", "far")
    found = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).collect()  # k rows for each of a few queries
    return under_line(codes, np.array([r["dist"] for r in found], float), np.array([r["far"] for r in found], float))


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): each query's k nearest found, nearest first.
    ``is_query`` is a condition on the column id."""
    spark = rows.sparkSession
    ship(spark)
    ok = usable(rows, key, vector)
    sizes = ok.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    queries = ok.where(is_query)
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["n"]
    ok, queries = ok.where(F.size("v") == d), queries.where(F.size("v") == d)
    by_hash = F.xxhash64(F.lit("fit"), "id", "row")
    sample = ok.orderBy(by_hash, "row").limit(SAMPLE).collect()
    codes = learn(np.array([r["v"] for r in sample], float))
    probes = queries.orderBy(by_hash, "row").limit(PROBES).collect()
    if probes:
        codes = calibrated(codes, ok, probes, k)
    few = sample[:min(BOUND, max(1, n // 4))]
    few = np.array([r["row"] for r in few]), np.array([r["v"] for r in few], float)
    # at least as many blocks as can run at once where there are rows for them, so that small tables spread too
    n_blocks = max(math.ceil(n * d * 4 / BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(n / SPREAD)))
    found = cut_lineage(probed(ok, queries, codes, n_blocks, d, k, few))
    short = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1))
    again = cut_lineage(queries.join(short, queries["row"] == short["query"], "left_anti"))
    if n > 1 and not again.isEmpty():
        found = found.join(again.select(F.col("row").alias("query")), "query", "left_anti").unionByName(probed(ok, again, codes, n_blocks, d, k, None))
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probed(ok: DataFrame, queries: DataFrame, codes: Codes, n_blocks: int, d: int, k: int, few: tuple | None) -> DataFrame:
    """query, query_id, row, vec_id, score: each block's k nearest of each query, k a query left of each task."""
    block = F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(n_blocks)).cast("int")
    every = ok.select(block.alias("block"), F.lit(False).alias("asks"), "row", "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), "row", "id", "v")
    # a block's rows come before the queries, so its index is built once and the queries go by
    dealt = every.unionByName(asked).repartition(n_blocks, "block").sortWithinPartitions("block", "asks")

    def bound(own: int, v: np.ndarray) -> float:
        """The k-th distance among a few sampled rows: no less than that among all."""
        if few is None:
            return math.inf
        dist = np.sqrt(((few[1] - v) ** 2).sum(axis=1))[few[0] != own]
        return float(np.partition(dist, k - 1)[k - 1]) if len(dist) >= k else math.inf

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for whole in batches:
            blocks, asks = whole.column("block").to_numpy(), whole.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                part = whole.slice(a, b - a)
                if blocks[a] != now:
                    now, held, index = blocks[a], [], None
                rows, ids, x = part.column("row").to_numpy(), part.column("id").to_numpy(), matrix(part.column("v"), d)
                if not asks[a]:
                    held.append((ids, rows, x))
                    continue
                if index is None and held:
                    index = Index(*[np.concatenate(c) for c in zip(*held, strict=True)], codes)
                    held = []
                if index is None:
                    continue
                out = []
                for own, query_id, v in zip(rows.tolist(), ids.tolist(), x.astype(np.float64), strict=True):
                    best, dist = index.nearest(own, v, k, bound(own, v))
                    out.append((np.full(len(best), own), np.full(len(best), query_id), index.rows[best], index.ids[best], dist))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "row", "vec_id", "score"])

    met = dealt.mapInArrow(probe, "query long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    # Spark keeps the first k of each query in every task before this shuffles
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
