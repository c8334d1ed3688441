"""Training rows as weighted cells, for the tree learners.

A tree sees of a numeric feature only which of ``max_bins`` bins a row falls into.  Rows with the same bins and the same
class are therefore one row with a weight; for a numeric target the cell's mean stands for its rows, since the spread inside
a cell is the same on both sides of every cut and leaves the gains and the leaf means as they are.  The rows are read a fixed number of
times for this, and the trees then grow on the cells, of which there are at most ``bins ** features``, whatever the table's size.

A forest draws rows with replacement: each row enters a tree Poisson(1) times.  The sum over a cell's n rows is Poisson(n), so
drawing that number once a cell and tree deals out the same samples.  A drawn cell's mean target is that of so many
draws from its rows: normal around the cell's mean with the cell's variance over the number drawn.  Draws depend on the
cell and the seed alone, so a task that runs again draws the same.

Tables whose rows share few cells (many features) aren't grouped: see ``cells_of``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.exprs import qcol
from tabforge.plans.boosting import SoftmaxBoosting, bin_values, binned, middles

LEAST_ROWS = 500_000  # fewer rows are quickly learned from as they are
SHARED = 4  # cells are used where they are at most a fourth of the rows
CELLS_PER_TASK = 50_000
TREES_AT_ONCE = 8
MOST_BROADCAST = 100_000  # scored kinds of rows that go to every task


@dataclass
class Cells:
    """``rows``: features (each bin's own value), label_idx, n (rows), and for a numeric target its spread ``var`` inside the cell."""
    rows: DataFrame
    count: int
    width: int
    n_classes: int | None
    whole: bool = False  # a cell's rows are alike in the features' own values


def cells_of(df: DataFrame, n: int, n_classes: int | None, max_bins: int, least_rows: int = LEAST_ROWS) -> Cells | None:
    """The persisted cells of a table with ``features`` and ``label_idx``, or None where grouping leaves more than a fourth of its ``n`` rows."""
    if n < max(least_rows, 1):
        return None
    base = df.select(vector_to_array("features").alias("x"), F.col("label_idx").alias("y"))
    width, unknown = base.agg(F.max(F.size("x")), F.sum(F.col("y").isNull().cast("int"))).first()
    if not width or unknown:  # a learner says what it makes of rows without a target
        return None
    values = bin_values(base, "x", width, max_bins)
    rows = base.select(binned("x", [middles(v) for v in values], width).alias("bins"), "y")
    keys = ["bins", "y"] if n_classes else ["bins"]
    most = float(np.prod([float(max(len(v), 1)) for v in values])) * (n_classes or 1)
    if SHARED * most > n and SHARED * rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] > n:
        return None
    sums = [F.count(F.lit(1)).cast("double").alias("n")]
    if not n_classes:
        sums += [F.avg("y").alias("y"), F.var_pop("y").alias("var")]
    grouped = rows.groupBy(*keys).agg(*sums)
    vector = array_to_vector(F.array(*[F.element_at(F.lit(v.tolist()).cast("array<double>"), F.col("bins")[f].cast("int") + 1)
                                       for f, v in enumerate(values)]))
    label = F.col("y").alias("label_idx", metadata=df.schema["label_idx"].metadata)
    cells = grouped.select(vector.alias("features"), label, "n", *([] if n_classes else ["var"]),
                           F.xxhash64(*keys).alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)
    return Cells(cells, cells.count(), width, n_classes)


def alike_of(base: DataFrame, prep, target: str, labels: list | None, prepare, max_bins: int, least_rows: int = LEAST_ROWS) -> Cells | None:
    """Cells without bins: rows alike in every raw feature (nulls filled) and class as one weighted row, or None where they are more
    than a fourth of the rows or a feature has more than ``max_bins`` values.  Nothing is lost in such cells, so linear models learn
    from them as well.  ``base``: the rows' features and target; ``prepare``: the preparation of some rows for the learners."""
    n, feats = prep.report["processed_rows"], prep.features
    if n < max(least_rows, 1):
        return None
    names = [f"__f{i}" for i in range(len(feats))]
    rows = prep.impute(base, [target]).select(*[qcol(c).alias(a) for a, c in zip(names, feats, strict=True)], qcol(target).alias("__y"))
    keys = names + ["__y"] * (labels is not None)
    known, about, *each = rows.agg(F.count("__y"), F.approx_count_distinct(F.xxhash64(*keys)), *[F.approx_count_distinct(c) for c in names]).first()
    if known < n or SHARED * about > n or max(each, default=0) > 1.2 * max_bins:
        return None
    sums = [F.count(F.lit(1)).cast("double").alias("__n")]
    if labels is None:
        sums += [F.avg(F.col("__y").cast("double")).alias("__y"), F.var_pop(F.col("__y").cast("double")).alias("__var")]
    grouped = rows.groupBy(*keys).agg(*sums).withColumn("__cell", F.xxhash64(*names, *keys[len(names):]))
    extra = {"__n": "n", "__cell": "cell"} | ({"__var": "var"} if labels is None else {})
    grouped = grouped.select(*[F.col(a).alias(c) for a, c in zip(names, feats, strict=True)], F.col("__y").alias(target), *extra)
    x = prepare(grouped, list(extra))
    cells = x.select("features", "label_idx", *[F.col(a).alias(b) for a, b in extra.items()]).persist(StorageLevel.MEMORY_AND_DISK)
    count = cells.count()
    values = cells.select(F.posexplode(vector_to_array("features"))).distinct().groupBy("pos").count().agg(F.max("count")).first()[0]
    if not count or (values or 0) > max_bins:
        cells.unpersist()
        return None
    return Cells(cells, count, len(feats), len(labels) if labels is not None else None, True)


def once_each(base: DataFrame, prep, target: str, score, n_columns: list[str], least_rows: int = LEAST_ROWS) -> DataFrame | None:
    """The target and the scored columns of the rows of ``base``, of which those alike in every raw feature are scored once, or None
    where few are alike.  ``score``: scores some rows, keeping the named columns."""
    feats = prep.features
    names = [f"__f{i}" for i in range(len(feats))]
    rows = prep.impute(base, [target]).select(*[qcol(c).alias(a) for a, c in zip(names, feats, strict=True)], qcol(target).alias("__y"))
    n, about = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*names))).first()
    if n < max(least_rows, 1) or SHARED * about > n or about > MOST_BROADCAST:
        return None
    kinds = rows.select(*names).distinct().select("*", *[F.col(a).alias(c) for a, c in zip(names, feats, strict=True)])
    return rows.join(F.broadcast(score(kinds, names).select(*names, *n_columns)), names).select(F.col("__y").alias(target), *n_columns)


def few_tasks(df: DataFrame, cells: int) -> DataFrame:
    return df.coalesce(max(1, -(-cells // CELLS_PER_TASK)))


def drawn(seed: int, trees: int) -> Column:
    """How often every tree draws a cell's rows, and for its mean a standard normal number."""
    @F.arrow_udf("struct<k:array<int>,z:array<float>>")
    def draw(cell: pa.Array, n: pa.Array) -> pa.Array:
        k, z = np.zeros((len(cell), trees), np.int32), np.zeros((len(cell), trees), np.float32)
        for i, (c, rows) in enumerate(zip(cell.to_pylist(), n.to_pylist(), strict=True)):
            rng = np.random.default_rng([seed, c & (1 << 64) - 1])
            k[i], z[i] = rng.poisson(rows, trees), rng.standard_normal(trees)
        ends = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * trees)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(a.ravel())) for a in (k, z)], ["k", "z"])

    return draw("cell", "n")


def fit_forest(est, cells: Cells):
    """The random forest ``est`` describes, grown on cells: every tree on its own draw of the rows."""
    trees, seed = est.getNumTrees(), est.getSeed()
    label = lambda c: c.alias("label_idx", metadata=cells.rows.schema["label_idx"].metadata)
    draws = few_tasks(cells.rows, cells.count).withColumn("drawn", drawn(seed & (1 << 63) - 1, trees))
    times = [F.col("drawn.k")[t].cast("double") for t in range(trees)]
    own = [k.alias(f"k{t}") for t, k in enumerate(times)]
    if not cells.n_classes:
        own += [(F.col("label_idx") + F.col("drawn.z")[t] * F.sqrt(F.col("var") / k)).alias(f"y{t}") for t, k in enumerate(times)]
    # a column a tree: the trees' jobs differ in the column they read alone, so Spark compiles their plan once
    rows = draws.select("features", "label_idx", *own).persist(StorageLevel.MEMORY_AND_DISK)
    seeds = np.random.SeedSequence(seed & (1 << 63) - 1).generate_state(trees, np.uint32).tolist()

    def grow(t: int):
        y = F.col("label_idx" if cells.n_classes else f"y{t}")
        mine = rows.select("features", label(y), F.col(f"k{t}").alias("times")).where("times > 0")
        return est.copy({est.numTrees: 1, est.bootstrap: False, est.weightCol: "times", est.seed: seeds[t]}).fit(mine)

    try:
        with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as pool:
            grown = list(pool.map(grow, range(trees)))
    finally:
        rows.unpersist()
    return one_forest(est, grown, cells)


def one_forest(est, grown: list, cells: Cells):
    """One model of forests of one tree, with the settings of ``est``."""
    sc = SparkContext._active_spark_context
    kind = "classification" if cells.n_classes else "regression"
    java = getattr(sc._jvm.org.apache.spark.ml, kind)
    tree = java.DecisionTreeClassificationModel if cells.n_classes else java.DecisionTreeRegressionModel
    every = sc._gateway.new_array(tree, len(grown))
    for t, model in enumerate(grown):
        every[t] = model._java_obj.trees()[0]
    if cells.n_classes:
        model = RandomForestClassificationModel(java.RandomForestClassificationModel(est.uid, every, cells.width, cells.n_classes))
    else:
        model = RandomForestRegressionModel(java.RandomForestRegressionModel(est.uid, every, cells.width))
    return est._copyValues(model)


def fit_weighted(est, cells: Cells):
    """Boosted trees, and on whole cells linear models, of ``pyspark.ml``: losses and gradients weigh a cell by its rows."""
    return est.copy({est.weightCol: "n"}).fit(few_tasks(cells.rows.select("features", "label_idx", "n"), cells.count))


def fit_on_cells(est, cells: Cells):
    if isinstance(est, SoftmaxBoosting):
        return est.fit(cells.rows, "n")
    return fit_forest(est, cells) if hasattr(est, "getNumTrees") else fit_weighted(est, cells)
