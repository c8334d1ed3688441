"""Leaderboard (H12-H13): primary value and rank of the models of each run.

Primary value is the AUC for classification (missing -> 0) and -RMSE for
regression (missing -> -inf), sorted descending and stable (ties keep the fixed
algorithm order), ranks 1..k without ties; RMSE is shown un-negated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.exprs import qcol


def primary_value(classification) -> F.Column:
    cls = classification if isinstance(classification, F.Column) else F.lit(bool(classification))
    return F.when(cls, F.coalesce(F.col("auc"), F.lit(0.0))).otherwise(
        -F.coalesce(F.col("rmse"), F.lit(float("inf"))))


def leaderboard(results: DataFrame, run: str = "run_id", ordinal: str = "algo_ordinal",
                classification="is_classification") -> DataFrame:
    """``results`` has run, algorithm ordinal, ``auc`` and/or ``rmse``; adds ``primary_metric_value`` and ``rank``."""
    cls = qcol(classification) if isinstance(classification, str) else F.lit(bool(classification))
    if "auc" not in results.columns:
        results = results.withColumn("auc", F.lit(None).cast("double"))
    if "rmse" not in results.columns:
        results = results.withColumn("rmse", F.lit(None).cast("double"))
    sort_key = primary_value(cls)
    w = Window.partitionBy(qcol(run)).orderBy(sort_key.desc(), qcol(ordinal).asc())
    return (results.withColumn("rank", F.row_number().over(w))
            .withColumn("primary_metric_value", F.when(cls, sort_key).otherwise(-sort_key)))
