"""Training (G1-G9, A7): three model families per problem type with ``pyspark.ml``,
held-out evaluation, ranking and model persistence.

Models train data-parallel on executors; only model parameters / trees return to
the driver.  The prepared training rows are persisted (memory and disk) while the
three estimators fit and released afterwards.  Forests depend on partitioning
even with a seed: with the same input files and settings the layout, and so the
model, repeats.  ``key_layout=True`` re-partitions the training rows by key and
sorts them (same rows -> same model under any input layout) at the cost of one
shuffle; a key holding a large share of rows then loads one task, so it is off
by default.  Inputs with fewer partitions than task slots are spread round-robin.
Forests and boosted trees grow on weighted cells of the binned rows where those are far fewer than the rows (``plans.cells``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.exprs import qcol
from tabforge.operators.metrics import classification_metrics, regression_metrics
from tabforge.operators.prep import FittedPrep
from tabforge.plans.boosting import SoftmaxBoosting, SoftmaxBoostModel
from tabforge.plans.cells import alike_of, cells_of, fit_on_cells, once_each

# fixed values: algorithm names and order per problem type
CLASSIFICATION_ALGORITHMS = ("Logistic Regression", "Random Forest", "Gradient Boosting")
REGRESSION_ALGORITHMS = ("Linear Regression", "Random Forest", "Gradient Boosting")
JOIN_LABELS = 200  # more labels than this are looked up by a join, not in a map literal
TREE_ROWS = 500_000  # rows a task of the tree learners where they learn from rows: a row there takes some bytes for every tree


SPARK_TREES = (GBTClassifier, GBTRegressor, RandomForestClassifier, RandomForestRegressor)


@dataclass
class TrainParams:
    """Library defaults follow the reference's estimators (scikit-learn defaults)."""
    lr_max_iter: int = 1000
    rf_trees: int = 100
    rf_max_depth: int = 30  # the reference grows trees without limit; 30 is the most pyspark.ml allows
    max_bins: int = 256  # split thresholds tried per feature: Spark bins a numeric feature into so many quantiles
    gbt_stages: int = 100
    gbt_max_depth: int = 3
    gbt_step: float = 0.1
    seed: int = 42


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def label_index(train: DataFrame, target: str) -> list:
    """Sorted distinct training labels in their own type (numeric order for numbers), however many.
    They are on the driver as the model's own classes are (a model keeps weights for every one of them)."""
    return sorted(r[0] for r in train.groupBy(qcol(target).alias("label")).count().select("label").collect())


def _lits(labels: list, dtype: T.DataType | None) -> list[Column]:
    return [F.lit(lab).cast(dtype) if dtype is not None else F.lit(lab) for lab in labels]


def label_to_index(col: Column, labels: list, dtype: T.DataType | None = None) -> Column:
    """Label -> class index (position in the sorted label list), as double for ``pyspark.ml``."""
    m = F.map_from_arrays(F.array(*_lits(labels, dtype)), F.array(*[F.lit(float(i)) for i in range(len(labels))]))
    return m[col]


def index_to_label(idx: Column, labels: list, dtype: T.DataType | None = None) -> Column:
    return F.element_at(F.array(*_lits(labels, dtype)), idx.cast("int") + 1)


def estimators(problem_type: str, n_classes: int, n_train: int, p: TrainParams) -> list[tuple[str, object]]:
    lab, feat = "label_idx", "features"
    if problem_type == "classification":
        gbt = GBTClassifier(maxIter=p.gbt_stages, maxDepth=p.gbt_max_depth, stepSize=p.gbt_step, seed=p.seed,
                            maxBins=p.max_bins, labelCol=lab, featuresCol=feat)
        return [
            # C = 1 on a sum of losses is regParam = 1/n on Spark's mean loss; intercept not penalised
            ("Logistic Regression", LogisticRegression(maxIter=p.lr_max_iter, regParam=1.0 / max(n_train, 1),
                                                       elasticNetParam=0.0, standardization=False, family="auto",
                                                       labelCol=lab, featuresCol=feat)),
            ("Random Forest", RandomForestClassifier(numTrees=p.rf_trees, featureSubsetStrategy="sqrt",
                                                     maxDepth=p.rf_max_depth, maxBins=p.max_bins, seed=p.seed, labelCol=lab,
                                                     featuresCol=feat)),
            # three classes or more: one loss for all of them together
            ("Gradient Boosting", gbt if n_classes <= 2 else SoftmaxBoosting(n_classes, p.gbt_stages, p.gbt_max_depth, p.gbt_step,
                                                                            p.max_bins, p.seed, lab)),
        ]
    return [
        ("Linear Regression", LinearRegression(solver="normal", regParam=0.0, labelCol=lab, featuresCol=feat)),
        ("Random Forest", RandomForestRegressor(numTrees=p.rf_trees, featureSubsetStrategy="all",
                                                maxDepth=p.rf_max_depth, maxBins=p.max_bins, seed=p.seed, labelCol=lab, featuresCol=feat)),
        ("Gradient Boosting", GBTRegressor(maxIter=p.gbt_stages, maxDepth=p.gbt_max_depth, stepSize=p.gbt_step,
                                           lossType="squared", maxBins=p.max_bins, seed=p.seed, labelCol=lab, featuresCol=feat)),
    ]


def probability_array(pred: DataFrame, model) -> Column:
    """Class probabilities as array<double>."""
    return vector_to_array("probability")


@dataclass
class TrainedModel:
    algorithm_name: str
    algo_ordinal: int
    model: object
    model_path: str | None = None
    metrics: dict = field(default_factory=dict)


def without_summary(model):
    """The model without its training summary.  A summary holds the training rows' plan and the session, and tasks that
    score with the model would be sent both (which fails once the session has observed a write)."""
    if getattr(model, "hasSummary", False) and hasattr(model, "_java_obj"):
        # the context of the process: models are fitted in threads, which have no active session
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def score_frame(model, df_x: DataFrame, problem_type: str, labels: list | None,
                label_type: T.DataType | None = None) -> DataFrame:
    """model.transform + label / probability columns: ``pred_label``, ``proba`` (array, classification)."""
    out = model.transform(df_x)
    if problem_type == "classification":
        out = out.withColumn("proba", probability_array(out, model))
        out = out.withColumn("pred_label", index_to_label(F.col("prediction"), labels, label_type))
    else:
        out = out.withColumn("pred_label", F.col("prediction"))
    return out


def evaluate(scored: DataFrame, target: str, problem_type: str, labels: list | None) -> DataFrame:
    """One-row metrics of a scored held-out set (accuracy/auc/precision/recall/f1 or rmse/mae/r2/mape)."""
    if problem_type == "classification":
        if len(labels) == 2:
            s = scored.withColumn("__score", F.col("proba")[1])
            return classification_metrics(s, target, "pred_label", score="__score", model_classes=labels)
        probs = {lab: f"__p{i}" for i, lab in enumerate(labels)}
        s = scored.select("*", *[F.col("proba")[i].alias(f"__p{i}") for i in range(len(labels))])
        return classification_metrics(s, target, "pred_label", prob_cols=probs, model_classes=labels)
    return regression_metrics(scored, target, "pred_label")


def prepare_xy(prep: FittedPrep, df: DataFrame, target: str, labels: list | None, keep: list[str],
               fit_rows: bool) -> DataFrame:
    t = prep.transform_fit if fit_rows else prep.transform_test
    x = t(df, keep=list(dict.fromkeys(keep + [target])), vector_col="features")
    dt = df.schema[target].dataType
    if labels is not None and len(labels) > JOIN_LABELS:
        schema = T.StructType([T.StructField("__label", dt), T.StructField("label_idx", T.DoubleType())])
        known = df.sparkSession.createDataFrame([(lab, float(i)) for i, lab in enumerate(labels)], schema)
        x = x.join(known, qcol(target) == F.col("__label"), "left").drop("__label")
    else:
        x = x.withColumn("label_idx", label_to_index(qcol(target), labels, dt) if labels is not None else qcol(target).cast("double"))
    if labels is None:
        return x
    # the number of classes goes with the column, so the tree learners neither look for it nor stop at 100
    return x.withMetadata("label_idx", {"ml_attr": {"type": "nominal", "num_vals": len(labels)}})


def train_all(spark: SparkSession, train: DataFrame, test: DataFrame, features: list[str], target: str,
              problem_type: str, *, keys: list[str] | None = None, params: TrainParams | None = None,
              artifacts: str | None = None, run_id: int | str = 0, algorithms: list[str] | None = None,
              prep_kw: dict | None = None, key_layout: bool = False, parallel: bool = False,
              spread: bool | None = None, on_prepared=None) -> tuple[FittedPrep, list | None, DataFrame, list[TrainedModel]]:
    """G7 + G8: fit preparation on ``train``, fit each model, score ``test``, evaluate, save, rank.

    ``spread`` deals the prepared rows over all task slots (None: where the scan has fewer partitions);
    ``on_prepared`` is called with the fitted preparation before any model is fitted.
    Returns (prep, labels, leaderboard DataFrame, trained models)."""
    from tabforge.operators.rank import leaderboard

    p = params or TrainParams()
    kw = dict(prep_kw or {})
    if any(train.schema[c].dataType.simpleString() == "boolean" for c in features):
        kw.setdefault("kind_source", train.unionByName(test))  # bool kind is a whole-table property
    keep = list(keys or []) if key_layout else []
    # every pass over the training rows reads these columns, so the split is worked out once
    base = train.select(*[qcol(c) for c in dict.fromkeys([*keep, *features, target])]).persist(StorageLevel.MEMORY_AND_DISK)
    prep = FittedPrep.fit(base, features, target, kept=True, **kw)
    if on_prepared:
        on_prepared(prep)
    labels = label_index(base, target) if problem_type == "classification" else None
    tr = prepare_xy(prep, base, target, labels, keep, True)
    try:
        par = spark.sparkContext.defaultParallelism
        parts = train.select(target).rdd.getNumPartitions() if spread is None else 0  # of the scan: no job runs
    except Exception:  # noqa: BLE001  (Connect session: leave the layout to the server)
        par, parts = 0, 0
    if keys and key_layout:
        tr = tr.repartition(max(1, par), *[qcol(k) for k in keys]).sortWithinPartitions(*[qcol(k) for k in keys])
    elif spread or (spread is None and parts < par):
        # few input splits (small files): spread rows round-robin over the cluster's task slots;
        # an even split, so no key can load one task.  Large inputs keep their scan partitions.
        tr = tr.repartition(par)
    tr = tr.select("features", "label_idx")
    te_base = test.select(*[qcol(c) for c in dict.fromkeys([*features, target])]).persist(StorageLevel.MEMORY_AND_DISK)
    te = prepare_xy(prep, te_base, target, labels, [], False)
    n_train = prep.report["processed_rows"]
    results, rows = [], []
    cols = ["pred_label"] + (["proba"] if problem_type == "classification" else [])

    def fit_one(i: int, name: str, est) -> tuple:
        if cells and (cells.whole or isinstance(est, SPARK_TREES)):
            model = without_summary(fit_on_cells(est, cells))
        elif not isinstance(est, SPARK_TREES):
            model = without_summary(est.fit(tr))
        else:
            wanted = -(-n_train // TREE_ROWS)
            model = without_summary(est.fit(tr.repartition(wanted) if 0 < parts < wanted and not key_layout else tr))
        label_type = test.schema[target].dataType
        scored = once_each(te_base, prep, target, lambda kinds, own: score_frame(
            model, prep.transform_test(kinds, keep=own, vector_col="features"), problem_type, labels, label_type), cols) if cells and cells.whole else None
        if scored is None:
            scored = score_frame(model, te, problem_type, labels, label_type).select(qcol(target), *cols)
        # model inference runs once: the narrow scored rows are kept while the metrics read them
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            m = evaluate(scored, target, problem_type, labels).first().asDict()
        finally:
            scored.unpersist()
        m = {k: (float(v) if v is not None else None) for k, v in m.items()}
        path = None
        if artifacts:
            path = f"{artifacts.rstrip('/')}/model_{run_id}_{snake(name)}"
            model.write().overwrite().save(path)
        return (TrainedModel(name, i, model, path, m),
                (str(run_id), name, i, path, m, m.get("auc"), m.get("rmse"), problem_type == "classification"))

    todo = [(i, name, est) for i, (name, est) in enumerate(estimators(problem_type, len(labels or []), n_train, p))
            if not algorithms or name in algorithms]
    cells = None
    try:
        if not key_layout:
            cells = alike_of(base, prep, target, labels, lambda some, own: prepare_xy(prep, some, target, labels, own, True), p.max_bins)
        if not cells:
            tr = tr.persist(StorageLevel.MEMORY_AND_DISK)
            if not key_layout and any(isinstance(est, SPARK_TREES) for _, _, est in todo):
                cells = cells_of(tr, n_train, len(labels) if labels is not None else None, p.max_bins)
        if parallel and len(todo) > 1:
            # the estimators are independent: submit their Spark jobs concurrently from driver threads
            from concurrent.futures import ThreadPoolExecutor
            with ThreadPoolExecutor(max_workers=len(todo)) as pool:
                done = list(pool.map(lambda t: fit_one(*t), todo))
        else:
            done = [fit_one(*t) for t in todo]
        for res, row in done:
            results.append(res)
            rows.append(row)
    finally:
        if cells:
            cells.rows.unpersist()
        tr.unpersist()
        base.unpersist()
        te_base.unpersist()
    schema = T.StructType([
        T.StructField("run_id", T.StringType()), T.StructField("algorithm_name", T.StringType()),
        T.StructField("algo_ordinal", T.IntegerType()), T.StructField("model_path", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())), T.StructField("auc", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()), T.StructField("is_classification", T.BooleanType())])
    lb = leaderboard(spark.createDataFrame(rows, schema), run="run_id", ordinal="algo_ordinal")
    return prep, labels, lb, results


def model_class(problem_type: str, n_classes: int, algorithm: str):
    """Loader class for a saved model."""
    from pyspark.ml.classification import (
        GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
    )
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
    if problem_type == "classification":
        return {"Logistic Regression": LogisticRegressionModel, "Random Forest": RandomForestClassificationModel,
                "Gradient Boosting": GBTClassificationModel if n_classes <= 2 else SoftmaxBoostModel}[algorithm]
    return {"Linear Regression": LinearRegressionModel, "Random Forest": RandomForestRegressionModel,
            "Gradient Boosting": GBTRegressionModel}[algorithm]
