"""Run-log tables and their queries.

The log is append-only Parquet: ``datasets``, ``experiments``, ``trained_models``
and ``run_events`` (status, promotion and removal rows).  Current state is a
query over the log (latest event wins), so concurrent runs never rewrite
shared rows.  Joins are by key with at most one match per row.

An experiment that runs again is a new *attempt*: its rows carry an ``attempt_id`` and
count only once the attempt's ``commit`` event is in the log, which is its last append.  So a run that
failed half-way shows its status and nothing else, and a rerun takes the place of what it repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "preprocessing", "training", "completed", "failed")  # fixed values
DISPLAY_TS = "dd/MM/yyyy HH:mm"  # fixed value: list display format

DATASETS = T.StructType([
    T.StructField("dataset_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("num_rows", T.LongType()),
    T.StructField("num_columns", T.IntegerType()), T.StructField("created_at", T.TimestampNTZType())])
EXPERIMENTS = T.StructType([
    T.StructField("experiment_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("dataset_id", T.LongType()), T.StructField("target_column", T.StringType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())), T.StructField("problem_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("attempt_id", T.StringType())])
MODELS = T.StructType([
    T.StructField("model_id", T.LongType()), T.StructField("experiment_id", T.LongType()),
    T.StructField("algorithm_name", T.StringType()), T.StructField("model_path", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("primary_metric_value", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("attempt_id", T.StringType())])
EVENTS = T.StructType([
    T.StructField("experiment_id", T.LongType()), T.StructField("model_id", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("deploy_api", T.BooleanType()), T.StructField("deploy_batch", T.BooleanType()),
    T.StructField("message", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()), T.StructField("attempt_id", T.StringType())])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def runs_with_dataset(experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """Experiments with their dataset name (null when the dataset is gone), newest first."""
    d = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    return (experiments.join(d, "dataset_id", "left")
            .select("experiment_id", "name", "dataset_id", "dataset_name", "problem_type", "created_at",
                    F.date_format("created_at", DISPLAY_TS).alias("created_display"))
            .orderBy(F.desc("created_at"), F.desc("experiment_id")))


def latest(df: DataFrame, ts: str = "created_at", id_col: str | None = None, n: int = 5) -> DataFrame:
    """Newest ``n`` rows (TakeOrderedAndProject: a top-n per partition, then one merge of n x partitions)."""
    order = [F.desc(ts)] + ([F.desc(id_col)] if id_col else [])
    return df.orderBy(*order).limit(n)


def best_model_per_run(experiments: DataFrame, models: DataFrame) -> DataFrame:
    """The rank-1 model of each experiment and its value (null when none)."""
    best = models.where(F.col("rank") == 1).select(
        "experiment_id", F.col("model_id").alias("best_model_id"), F.col("algorithm_name").alias("best_algorithm"),
        F.col("primary_metric_value").alias("best_value"))
    return experiments.select("experiment_id", "name").join(best, "experiment_id", "left")


def models_by_rank(models: DataFrame) -> DataFrame:
    """Models of each experiment by rank, null/0 rank last (as 999)."""
    key = F.coalesce(F.when(F.col("rank") != 0, F.col("rank")), F.lit(999))
    return models.withColumn("rank_order", key).orderBy("experiment_id", "rank_order", "model_id")


def promotion_state(models: DataFrame, events: DataFrame) -> DataFrame:
    """Deploy flags after a log of promotions ``(experiment_id, model_id, deploy_api, deploy_batch, seq)``.

    A promotion sets both flags of the chosen model as given and switches off, in the other
    models of the experiment, each flag it switches on.  So a model's flag is its own latest
    promotion, unless a later promotion of another model switched that flag on.
    """
    ev = events.where(F.col("kind") == "promote")
    own = ev.groupBy("model_id").agg(F.max_by(F.struct("seq", "deploy_api", "deploy_batch"), "seq").alias("own"))
    # per experiment, the latest promotion that switched each flag on (max_by skips null orderings)
    on = ev.groupBy("experiment_id").agg(*[
        F.max_by(F.struct("seq", "model_id"), F.when(F.col(flag), F.col("seq"))).alias(f"on_{flag}")
        for flag in ("deploy_api", "deploy_batch")])
    m = models.join(own, "model_id", "left").join(on, "experiment_id", "left")
    out = []
    for flag in ("deploy_api", "deploy_batch"):
        o = F.col(f"on_{flag}")  # null struct when no promotion switched the flag on
        own_seq, own_val = F.col("own.seq"), F.col(f"own.{flag}")
        val = (F.when(o.isNull(), F.coalesce(own_val, F.lit(False)))
               .when(o["model_id"] == F.col("model_id"), own_val)
               .when(own_seq.isNotNull() & (own_seq > o["seq"]), own_val)
               .otherwise(F.lit(False)))
        out.append(val.alias(f"is_{flag.replace('deploy_', 'deployed_')}"))
    return m.select("model_id", "experiment_id", *out)


def promoted_model(state: DataFrame, flag: str = "is_deployed_batch") -> DataFrame:
    """Per experiment the first model (lowest id) carrying the flag."""
    w = Window.partitionBy("experiment_id").orderBy("model_id")
    return (state.where(F.col(flag)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
            .select("experiment_id", "model_id"))


def purge_cascade(datasets: DataFrame, experiments: DataFrame, models: DataFrame,
                  tombstones: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop removed datasets, their experiments, removed experiments, and all their models.

    ``tombstones`` is ``(kind in {'dataset','experiment'}, id)``; removal is left-anti joins down
    the chain (rows only; file deletion belongs to the storage layer)."""
    dead_d = tombstones.where(F.col("kind") == "dataset").select(F.col("id").alias("dataset_id")).distinct()
    dead_e = tombstones.where(F.col("kind") == "experiment").select(F.col("id").alias("experiment_id")).distinct()
    d2 = datasets.join(dead_d, "dataset_id", "left_anti")
    e2 = experiments.join(dead_d, "dataset_id", "left_anti").join(dead_e, "experiment_id", "left_anti")
    m2 = models.join(e2.select("experiment_id"), "experiment_id", "left_semi")
    return d2, e2, m2


def current_status(events: DataFrame) -> DataFrame:
    """Status of each experiment = its latest status event by (ts, seq); failures keep the message."""
    st = events.where(F.col("kind") == "status")
    last = st.groupBy("experiment_id").agg(
        F.max_by(F.struct("status", "message"), F.struct("ts", "seq")).alias("last"),
        F.count(F.lit(1)).alias("n_events"))
    return last.select("experiment_id", F.col("last.status").alias("status"),
                       F.col("last.message").alias("message"), "n_events")


def last_commits(events: DataFrame) -> DataFrame:
    """(experiment_id, attempt_id) of each experiment's newest committed attempt, by (ts, seq, attempt_id)."""
    ev = events.where((F.col("kind") == "commit") & F.col("attempt_id").isNotNull())
    last = ev.groupBy("experiment_id").agg(F.max(F.struct("ts", "seq", "attempt_id")).alias("last"))
    return last.select("experiment_id", F.col("last.attempt_id").alias("attempt_id"))


def committed_rows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The rows (models, fit reports) of each experiment's newest committed attempt.  Rows that carry no attempt id, as
    logs had before attempts, count while their experiment has no committed attempt."""
    last = last_commits(events).select(F.col("experiment_id").alias("__exp"), F.col("attempt_id").alias("__att"))
    return (rows.join(last, F.col("experiment_id") == F.col("__exp"), "left")
            .where(F.col("attempt_id").eqNullSafe(F.col("__att"))).drop("__exp", "__att"))


def promotions_of(models: DataFrame, events: DataFrame) -> DataFrame:
    """The promotions of these models only: one of a model that doesn't count switches nothing off elsewhere."""
    return events.where(F.col("kind") == "promote").join(models.select("model_id"), "model_id", "left_semi")


def current_experiments(experiments: DataFrame) -> DataFrame:
    """One row an experiment: that of its newest attempt, committed or not (a failed run stays in the list with its status)."""
    cols = experiments.columns
    newest = experiments.groupBy("experiment_id").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "attempt_id")).alias("newest"))
    return newest.select(*[F.col(f"newest.{c}").alias(c) for c in cols])


def commit_event(spark: SparkSession, experiment_id: int, attempt_id: str, seq: int) -> DataFrame:
    """What makes an attempt's rows count.  Appended after everything else of the attempt."""
    import datetime as _dt

    row = (experiment_id, None, "commit", None, None, None, None, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), seq,
           attempt_id)
    return spark.createDataFrame([row], EVENTS)


def first_model_id(attempt_id: str, now_ms: int) -> int:
    """The first of four ids for an attempt's models: 41 bits of milliseconds, 20 of the attempt, two left for the model, so
    ids grow with time (J6 takes the lowest) and two attempts share one only in one millisecond and 1 case of 2^20."""
    return (now_ms << 22) | (int(attempt_id[:5], 16) << 2)


def read_log(spark: SparkSession, log_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A log table, empty where nothing was appended yet; older files without the newest columns read as null there."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(f"{log_dir}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def visible_models(spark: SparkSession, log_dir: str) -> DataFrame:
    """Models that count: those of committed attempts."""
    return committed_rows(read_log(spark, log_dir, "trained_models", MODELS), read_log(spark, log_dir, "run_events", EVENTS))


def promote_event(spark: SparkSession, experiment_id: int, model_id: int, deploy_api: bool, deploy_batch: bool,
                  seq: int) -> DataFrame:
    """J5 writer: one promotion (both flags of the chosen model as given; the others lose the flags switched on)."""
    import datetime as _dt

    row = (experiment_id, model_id, "promote", None, bool(deploy_api), bool(deploy_batch), None,
           _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), seq, None)
    return spark.createDataFrame([row], EVENTS)


def check_deployed(state: DataFrame, model_id: int, flag: str = "is_deployed_batch") -> None:
    """Gate before scoring: the model must carry the deploy flag (reads one row of the state)."""
    row = state.where(F.col("model_id") == F.lit(model_id)).select(flag).first()
    if row is None:
        raise LookupError(f"model {model_id} not found")
    if not row[flag]:
        raise PermissionError(f"model {model_id} is not deployed for {flag.replace('is_deployed_', '')}")


BATCH_RESULTS = T.StructType([
    T.StructField("result_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("num_rows", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("fmt", T.StringType())])


def batch_result(spark: SparkSession, log_dir: str, result_id: str):
    """I8 lookup: the run-log row of a batch result and its rows (the preview is ``.limit(10)`` of them)."""
    from tabforge.sources.csv import read_csv
    log = spark.read.schema(BATCH_RESULTS).parquet(f"{log_dir}/batch_results")
    row = log.where(F.col("result_id") == F.lit(result_id)).first()
    if row is None:
        return None, None
    return row, read_csv(spark, row["path"]) if row["fmt"] == "csv" else spark.read.parquet(row["path"])


def status_event(spark: SparkSession, experiment_id: int, status: str, seq: int, message: str | None = None,
                 attempt_id: str | None = None):
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    import datetime as _dt

    row = (experiment_id, None, "status", status, None, None, message, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), seq,
           attempt_id)
    return spark.createDataFrame([row], EVENTS)
