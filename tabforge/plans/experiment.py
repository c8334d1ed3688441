"""One experiment end to end (G8 + run log): the job the reference runs in the background.

project -> drop null targets -> hash split (before any fitting) -> fit preparation on
train -> train the three models -> evaluate on held-out rows -> rank -> save the
preparation and models -> append model rows and status events to the run log.
A failure appends a ``failed`` event with the error text and re-raises.  Each call is an attempt of
its own: artifacts lie in its own folder, and its models count from its ``commit`` event on (``runlog.visible_models``).
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import runlog as RL
from tabforge.operators.prep import report_frame
from tabforge.operators.schema import check_features, project_features, with_target
from tabforge.operators.split import split_hash
from tabforge.plans.score import ScoringBundle
from tabforge.plans.train import TrainParams, train_all


def _status(spark: SparkSession, log_dir: str, experiment_id: int, status: str, seq: int,
            message: str | None = None, attempt_id: str | None = None) -> None:
    RL.append(RL.status_event(spark, experiment_id, status, seq, message, attempt_id), f"{log_dir}/run_events")


def run_experiment(spark: SparkSession, df: DataFrame, features: list[str], target: str, problem_type: str, *,
                   keys: list[str], log_dir: str, experiment_id: int, name: str = "", dataset_id: int | None = None,
                   params: TrainParams | None = None, seed: int = 42, test_fraction: float = 0.2,
                   parallel: bool = True) -> DataFrame:
    """Runs one experiment and returns its leaderboard (model rows as appended to ``trained_models``)."""
    check_features(features, target, problem_type)
    attempt = uuid.uuid4().hex
    exp = spark.createDataFrame(
        [(experiment_id, name, dataset_id, target, list(features), problem_type, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), attempt)], RL.EXPERIMENTS)
    RL.append(exp, f"{log_dir}/experiments")
    _status(spark, log_dir, experiment_id, "pending", 0, attempt_id=attempt)
    try:
        _status(spark, log_dir, experiment_id, "preprocessing", 1, attempt_id=attempt)
        cols = list(dict.fromkeys(list(keys) + list(features) + [target]))
        data = project_features(df, cols)
        train, test = split_hash(with_target(data, target), keys, seed, test_fraction)
        artifacts = f"{log_dir}/artifacts/{attempt}"

        def prepared(prep) -> None:
            """The fit's report joins the log, and only then training begins."""
            report = (report_frame(spark, prep).withColumn("experiment_id", F.lit(experiment_id).cast("bigint"))
                      .withColumn("attempt_id", F.lit(attempt)))
            RL.append(report, f"{log_dir}/fit_reports")
            _status(spark, log_dir, experiment_id, "training", 2, attempt_id=attempt)

        prep, labels, lb, res = train_all(spark, train, test, features, target, problem_type, keys=keys,
                                          params=params, artifacts=artifacts, run_id=experiment_id, parallel=parallel,
                                          on_prepared=prepared)
        prep.save(f"{artifacts}/pipeline_{experiment_id}")
        for r in res:
            ScoringBundle(prep, r.model, problem_type, r.algorithm_name, labels,
                          df.schema[target].dataType.simpleString()).save(f"{r.model_path}_bundle")
        first = RL.first_model_id(attempt, int(time.time() * 1000))
        rows = lb.select(
            (F.lit(first) + F.col("algo_ordinal")).cast("bigint").alias("model_id"),
            F.lit(experiment_id).cast("bigint").alias("experiment_id"), "algorithm_name", "model_path", "metrics",
            "primary_metric_value", F.col("rank").cast("int").alias("rank"),
            F.lit(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("created_at"),
            F.lit(attempt).alias("attempt_id"))
        RL.append(rows, f"{log_dir}/trained_models")
        RL.append(RL.commit_event(spark, experiment_id, attempt, 4), f"{log_dir}/run_events")
        _status(spark, log_dir, experiment_id, "completed", 3, attempt_id=attempt)
        return lb
    except Exception as e:  # noqa: BLE001
        _status(spark, log_dir, experiment_id, "failed", 9, str(e), attempt)
        raise
