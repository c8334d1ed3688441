"""Multiclass gradient boosting on the joint softmax loss (G3 for three or more classes).

A stage fits one regression tree a class to the residuals ``y_k - p_k`` of all rows; all classes' trees grow side by side,
a level at a time.  Features are cut into at most ``max_bins`` bins once, and rows alike in bins and class become one weighted row.  A level is one job: every task adds up residuals and their
Newton weights by class, node, feature and bin in arrays of that fixed size, grouped sums bring the tasks' cells together, and the
driver takes the cut of largest gain for each node.  Leaf values are not the trees' means but one Newton step of the joint
loss, ``(K - 1) / K * sum(r) / sum(|r| (1 - |r|))``, from the same sums, so a stage reads the rows ``depth`` times whatever the
number of classes.  Scores start at the log shares of the classes and grow by ``step`` times the leaf values.

Cells that come to the driver are bounded by ``MAX_CELLS``: wider tables go through a level in several groups of features.  Scores
are written to the shared folder every ``CUT`` stages; the trees since then go with each job, so its plan stays a scan and one sum.
Trees travel as arrays and are walked for a whole Arrow batch at once, so scoring is narrow and works on streams.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import cut_lineage

CUT, MAX_CELLS, TINY = 10, 2_000_000, 1e-150
ROWS_OF_A_TASK = 50_000  # so few weighted rows go through a level in one task, without a shuffle


def bin_values(df: DataFrame, x: str, width: int, max_bins: int) -> list[np.ndarray]:
    """Per feature a value for each of its bins: all values where there are at most ``max_bins`` of them, else quantiles."""
    if not width:
        return []
    about = df.agg(*[F.approx_count_distinct(F.col(x)[f]).alias(str(f)) for f in range(width)]).first()
    few = [f for f in range(width) if (about[str(f)] or 0) <= 1.2 * max_bins]
    values: dict[int, list[float]] = {f: [] for f in few}
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(x)[f].alias("v")) for f in few])).alias("s")
        # at most a little over max_bins rows a feature
        for r in df.select(cells).groupBy("s.f", "s.v").count().collect():
            values[r["f"]].append(r["v"])
    many = [f for f in range(width) if f not in values or len(values[f]) > max_bins]
    if many:
        cuts = [(b + 0.5) / max_bins for b in range(max_bins)]
        named = df.select(*[F.col(x)[f].alias(f"f{f}") for f in many])
        values.update(zip(many, named.stat.approxQuantile([f"f{f}" for f in many], cuts, 0.25 / max_bins), strict=True))
    return [np.unique([a for a in values[f] if a is not None and not math.isnan(a)]) for f in range(width)]


def middles(values: np.ndarray) -> np.ndarray:
    """The thresholds between bins: halfway between neighbours."""
    return (values[1:] + values[:-1]) / 2


@dataclass
class Forest:
    """A stage's growing trees, one a class, in heap order of a complete tree: feature and bin (a row goes left up to it)."""
    feature: np.ndarray
    bin: np.ndarray

    def place(self, bins: np.ndarray, level: int) -> np.ndarray:
        """The node, counted from the level's left, of every row and class."""
        at = np.zeros((len(bins), len(self.feature)), np.int64)
        trees = np.arange(len(self.feature))[None, :]
        for _ in range(level):
            at = 2 * at + 1 + (np.take_along_axis(bins, self.feature[trees, at], axis=1) > self.bin[trees, at])
        return at - ((1 << level) - 1)


def residuals(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals by row and class, and the probability of each row's class."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = p[np.arange(len(y)), y].copy()
    p = -p
    p[np.arange(len(y)), y] += 1.0
    return p, own


def wide(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind, copy=False)


def shares(scores: str) -> Column:
    """Softmax of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


@dataclass
class SoftmaxBoostModel:
    """Trees by stage and class: feature and threshold [stage, class, inner node], value [stage, class, leaf] with the step in it."""
    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    num_features: int
    losses: list[float] = field(default_factory=list)  # mean log loss before the first stage and after each

    @property
    def numClasses(self) -> int:  # noqa: N802  (named as in pyspark.ml)
        return len(self.start)

    def raw(self, x: Column) -> Column:
        """Scores of a column of feature arrays."""
        start, feature, threshold, value = self.start, self.feature, self.threshold, self.value
        n_stages, n_classes, inner = feature.shape
        depth, width = (inner + 1).bit_length() - 1, self.num_features

        @F.arrow_udf("array<double>")
        def score(rows: pa.Array) -> pa.Array:
            v = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
            total = np.tile(start, (len(v), 1))
            trees = np.arange(n_classes)[None, :]
            for s in range(n_stages):
                at = np.zeros((len(v), n_classes), np.int64)
                for _ in range(depth):
                    right = np.take_along_axis(v, feature[s][trees, at], axis=1) > threshold[s][trees, at]
                    at = 2 * at + 1 + right
                total += value[s][trees, at - inner]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * n_classes), pa.array(total.ravel()))

        return score(x)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability (vectors) and prediction (the class index, the first of equals)."""
        out = df.withColumn("__raw", self.raw(vector_to_array("features"))).withColumn("__p", shares("__raw"))
        return out.withColumns({
            "rawPrediction": array_to_vector("__raw"), "probability": array_to_vector("__p"),
            "prediction": (F.array_position("__p", F.array_max("__p")) - 1).cast("double")}).drop("__raw", "__p")

    # the calls of pyspark.ml's writers, so that callers need not know which kind of model they hold
    def write(self) -> SoftmaxBoostModel:
        return self

    def overwrite(self) -> SoftmaxBoostModel:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(s, k, self.feature[s, k].tolist(), self.threshold[s, k].tolist(), self.value[s, k].tolist())
                for s in range(self.feature.shape[0]) for k in range(self.numClasses)]
        spark.createDataFrame(rows, "stage int, class int, feature array<int>, threshold array<double>, value array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = json.dumps({"start": self.start.tolist(), "num_features": self.num_features, "inner": int(self.feature.shape[2]), "losses": self.losses})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> SoftmaxBoostModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/about").collect()))
        trees = spark.read.parquet(f"{path}/trees").orderBy("stage", "class").collect()
        k, inner = len(meta["start"]), meta["inner"]
        shape = (len(trees) // k, k, inner)
        return cls(np.array(meta["start"]), np.array([r["feature"] for r in trees], np.int64).reshape(shape),
                   np.array([r["threshold"] for r in trees], float).reshape(shape),
                   np.array([r["value"] for r in trees], float).reshape(*shape[:2], inner + 1), meta["num_features"], meta["losses"])


@dataclass
class SoftmaxBoosting:
    """The estimator: ``fit`` takes a table with a vector column ``features`` and class indexes in ``label_idx``."""
    n_classes: int
    stages: int = 100
    depth: int = 3
    step: float = 0.1
    max_bins: int = 256
    seed: int = 42
    labelCol: str = "label_idx"

    def fit(self, df: DataFrame, weight: str | None = None) -> SoftmaxBoostModel:
        """``weight``: a column with the number of rows that a row stands for (of so many as to hold every value of a feature)."""
        k, depth = self.n_classes, self.depth
        base = df.select(vector_to_array("features").alias("x"), F.col(self.labelCol).cast("int").alias("y"),
                         (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        seen = base.groupBy("y").agg(F.sum("n").alias("n"), F.max(F.size("x")).alias("width")).collect()  # one row a class
        n, width = sum(r["n"] for r in seen), max((r["width"] for r in seen), default=0)
        share = {r["y"]: r["n"] / n for r in seen}
        start = np.log(np.clip([share.get(c, 0.0) for c in range(k)], np.finfo(np.float32).eps, 1.0))
        edges = [middles(v) for v in bin_values(base, "x", width, self.max_bins)]
        # rows alike in bins and class have the same score in every stage: they go through the stages as one row of weight n
        alike = base.select(binned("x", edges, width).alias("bins"), "y", "n").groupBy("bins", "y").agg(F.sum("n").alias("n"))
        rows = cut_lineage(alike.select("bins", "y", "n", F.lit(start.tolist()).alias("scores")))
        base.unpersist()
        if one_task := rows.count() <= ROWS_OF_A_TASK:
            rows = rows.coalesce(1)
        rows, losses, trees, recent = rows.persist(StorageLevel.MEMORY_AND_DISK), [], [], []
        for _ in range(self.stages):
            if len(recent) == CUT:
                rows, before = cut_lineage(rows.select("bins", "y", "n", added(recent, k, width).alias("scores"))), rows
                before.unpersist()
                rows, recent = rows.persist(StorageLevel.MEMORY_AND_DISK), []
            forest, sums = Forest(np.zeros((k, (1 << depth) - 1), np.int64), np.full((k, (1 << depth) - 1), self.max_bins, np.int64)), None
            for level in range(depth):
                sums, loss = grow(rows, recent, forest, level, [len(e) + 1 for e in edges], k, one_task)
                if level == 0:
                    losses.append(loss / max(n, 1))
            value = np.zeros((k, 1 << depth))
            if sums is not None:
                g, h = sums  # of the leaves
                safe = np.abs(h) > TINY
                value[safe] = self.step * (k - 1) / k * g[safe] / h[safe]
            recent.append((forest, value))
            trees.append((forest, value))
        losses.append((rows.select("y", "n", added(recent, k, width).alias("s")).agg(F.sum(-F.ln(shares("s")[F.col("y")]) * F.col("n"))).first()[0] or 0.0) / max(n, 1))
        rows.unpersist()
        ends = [np.append(e, np.inf) for e in edges]
        threshold = [[[ends[f][b] if f < len(ends) and b < len(ends[f]) else np.inf for f, b in zip(fs, bs, strict=True)]
                      for fs, bs in zip(t.feature, t.bin, strict=True)] for t, _ in trees]
        inner = (1 << depth) - 1
        return SoftmaxBoostModel(start, np.array([t.feature for t, _ in trees], np.int64).reshape(-1, k, inner),
                                 np.array(threshold, float).reshape(-1, k, inner), np.array([v for _, v in trees], float).reshape(-1, k, inner + 1),
                                 width, losses)


def binned(x: str, edges: list[np.ndarray], width: int) -> Column:
    """The bins of a column of feature arrays."""
    @F.arrow_udf("array<smallint>")
    def cut(rows: pa.Array) -> pa.Array:
        v = wide(rows, width, float)
        out = np.column_stack([np.searchsorted(e, v[:, f], side="left") for f, e in enumerate(edges)]).astype(np.int16) if width else np.zeros((len(v), 0), np.int16)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return cut(x)


def with_trees(scores: np.ndarray, bins: np.ndarray, recent: list[tuple[Forest, np.ndarray]]) -> np.ndarray:
    """The scores with the leaf values of some stages."""
    for forest, value in recent:
        at = forest.place(bins, value.shape[1].bit_length() - 1)
        scores = scores + value[np.arange(len(value))[None, :], at]
    return scores


def added(recent: list[tuple[Forest, np.ndarray]], k: int, width: int) -> Column:
    """The column ``scores`` with the leaf values of some stages."""
    read, with_recent = wide, with_trees

    @F.arrow_udf("array<double>")
    def add(b: pa.Array, s: pa.Array) -> pa.Array:
        total = with_recent(read(s, k, float), read(b, width, np.int64), recent)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * k), pa.array(total.ravel()))

    return add("bins", "scores")


def grow(rows: DataFrame, recent: list, forest: Forest, level: int, sizes: list[int], k: int, one_task: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Cut every node of a level where that gains most (``forest`` is written) and return the residual and weight sums of the
    next level's nodes, by class and node, and the loss of the present scores."""
    nodes, width, top = 1 << level, len(sizes), max(sizes, default=1)
    first = (1 << level) - 1
    best = np.full((k, nodes), 0.0)
    # a node that isn't cut sends all rows left
    sums = np.zeros((2, k, nodes, 2))
    loss = 0.0
    per = max(1, MAX_CELLS // (k * nodes * top))
    for begin in range(0, max(width, 1), per):
        features = list(range(begin, min(width, begin + per)))
        g, h, n, loss = cells(rows, recent, forest, level, features, top, k, width, one_task)
        if not features:
            break
        left = [np.cumsum(a, axis=3) for a in (g, h, n)]
        every = [a[..., -1:] for a in left]
        gl, nl = left[0], left[2]
        gr, nr = every[0] - gl, every[2] - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((nl > 0) & (nr > 0), gl ** 2 / nl + gr ** 2 / nr - every[0] ** 2 / every[2], 0.0)
        if begin == 0:
            sums[:, :, :, 0] = every[0][:, :, 0, 0], every[1][:, :, 0, 0]
        flat = gain.reshape(k, nodes, -1)
        cut = flat.argmax(axis=2)
        found = np.take_along_axis(flat, cut[..., None], axis=2)[..., 0]
        for c, node in np.argwhere(found > np.maximum(best, 1e-12)).tolist():
            best[c, node] = found[c, node]
            f, b = divmod(int(cut[c, node]), top)
            forest.feature[c, first + node], forest.bin[c, first + node] = features[f], b
            for j in range(2):
                sums[j, c, node] = left[j][c, node, f, b], every[j][c, node, f, 0] - left[j][c, node, f, b]
    return (sums[0].reshape(k, 2 * nodes), sums[1].reshape(k, 2 * nodes)), loss


def cells(rows: DataFrame, recent: list, forest: Forest, level: int, features: list[int], top: int, k: int, width: int,
          one_task: bool = False):
    """Residuals, weights and rows by (class, node, feature, bin), and the loss: each task adds up its own, then grouped sums.
    ``one_task``: the rows are so few that a task holds them, whose sums are all there is to sum."""
    nodes, some = 1 << level, len(features)
    shape = (k, nodes, some, top)
    size = k * nodes * some * top
    place, residual, read, with_recent = forest.place, residuals, wide, with_trees

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((3, size)), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            bins, y, times = read(b.column("bins"), width, np.int64), b.column("y").to_numpy(), b.column("n").to_numpy().astype(float)
            r, own = residual(with_recent(read(b.column("scores"), k, float), bins, recent), y)
            loss -= float((times * np.log(own)).sum())
            at = place(bins, level) + np.arange(k)[None, :] * nodes
            if some:
                cell = ((at[:, :, None] * some + np.arange(some)) * top + bins[:, None, features]).ravel()
                weight = np.abs(r) * (1.0 - np.abs(r))
                for j, w in enumerate((r, weight, np.ones_like(r))):
                    total[j] += np.bincount(cell, np.repeat((w * times[:, None]).ravel(), some), size)
        seen = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_pydict({"cell": np.append(seen, -1), "g": np.append(total[0][seen], loss), "h": np.append(total[1][seen], 0.0),
                                          "n": np.append(total[2][seen], 0.0)})

    met = rows.select("bins", "y", "n", "scores").mapInArrow(add_up, "cell long, g double, h double, n double")
    found = (met if one_task else met.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))).toArrow()
    cell = found["cell"].to_numpy()
    inner = cell >= 0
    out = [np.zeros(size) for _ in range(3)]
    for j, name in enumerate("ghn"):
        out[j][cell[inner]] = found[name].to_numpy()[inner]
    return *[a.reshape(shape) for a in out], float(found["g"].to_numpy()[~inner].sum())
