"""Metrics against brute-force definitions (pairwise AUC, per-class confusion counts)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import metrics as M
from tabforge.operators.rank import leaderboard


def brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties_and_buckets(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600).tolist()
    s = (rng.integers(0, 40, 600) / 4.0).tolist()  # many ties
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    want = brute_auc(y, s)
    one = M.auc(df, F.col("y"), F.col("s")).first()["auc"]
    many = M.auc(df, F.col("y"), F.col("s"), max_scores_per_task=5).first()["auc"]
    assert one == pytest.approx(want, abs=1e-12) and many == pytest.approx(want, abs=1e-12)


def test_auc_undefined_and_fallback(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9), (0, 0, 0.3)], "y int, p int, s double")
    assert M.auc(df, F.col("y"), F.col("s")).first()["auc"] is None
    m = M.classification_metrics(df, "y", "p", score="s").first()
    assert m["auc"] == pytest.approx(2 / 3)  # single class in the labels -> accuracy


def sk_prf(y, p, pos=1):
    labels = sorted(set(y) | set(p), key=str)
    if len(set(y)) == 2:
        if len(labels) > 2 or pos not in labels:
            return 0.0, 0.0, 0.0
        labels = [pos]
        weights = [1.0]
    else:
        weights = [sum(1 for v in y if v == c) for c in labels]
    out = []
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        pr = tp / (tp + fp) if tp + fp else 0.0
        rc = tp / (tp + fn) if tp + fn else 0.0
        f = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        out.append((pr, rc, f))
    w = np.array(weights, dtype=float)
    return tuple(float((np.array(col) * w).sum() / w.sum()) for col in zip(*out))


@pytest.mark.parametrize("y,p", [
    ([0, 1, 1, 0, 1], [0, 1, 0, 0, 1]),          # binary
    ([0, 2, 2, 0], [0, 2, 0, 0]),                # binary without label 1 -> zeros
    ([0, 1, 1, 0], [0, 2, 1, 0]),                # third class among predictions -> zeros
    ([0, 1, 2, 2, 1], [0, 2, 2, 1, 1]),          # multiclass weighted
    ([1, 1, 1], [1, 0, 1]),                      # one class in labels -> weighted
])
def test_precision_recall_f1_rules(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    got = M.precision_recall_f1(df, "y", "p", positive_label=1).first()
    want = sk_prf(y, p)
    assert (got["precision"], got["recall"], got["f1"]) == pytest.approx(want)


def test_regression_metrics(spark):
    y = [3.0, 0.0, 5.0, 2.5]
    p = [2.5, 0.5, 4.0, 3.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    m = M.regression_metrics(df, "y", "p").first()
    ya, pa = np.array(y), np.array(p)
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean((ya - pa) ** 2)))
    assert m["mae"] == pytest.approx(np.mean(np.abs(ya - pa)))
    assert m["r2"] == pytest.approx(1 - np.sum((ya - pa) ** 2) / np.sum((ya - ya.mean()) ** 2))
    nz = ya != 0
    assert m["mape"] == pytest.approx(np.mean(np.abs((ya[nz] - pa[nz]) / ya[nz])) * 100)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert M.regression_metrics(const, "y", "p").first()["r2"] == 1.0


def test_leaderboard_stable_ranks(spark):
    rows = [("r", "a", 0, 0.7, None, True), ("r", "b", 1, 0.9, None, True), ("r", "c", 2, 0.7, None, True),
            ("q", "a", 0, None, 3.0, False), ("q", "b", 1, None, 1.0, False), ("q", "c", 2, None, None, False)]
    df = spark.createDataFrame(rows, "run_id string, algo string, algo_ordinal int, auc double, rmse double, "
                                     "is_classification boolean")
    out = {(r["run_id"], r["algo"]): (r["rank"], r["primary_metric_value"]) for r in leaderboard(df).collect()}
    assert out[("r", "b")][0] == 1 and out[("r", "a")][0] == 2 and out[("r", "c")][0] == 3
    assert out[("q", "b")] == (1, 1.0) and out[("q", "a")] == (2, 3.0) and out[("q", "c")][0] == 3
