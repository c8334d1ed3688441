"""Multiclass boosting goes through its stages with one row a cell."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.plans.boosting import SoftmaxBoosting


def test_softmax_stages_read_one_row_a_cell(spark, monkeypatch):
    from tabforge.plans import boosting
    seen = []
    cut = boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda d: seen.append(cut(d)) or seen[-1])
    x = np.random.default_rng(6).integers(0, 8, size=(2000, 2)).astype(float)
    data = [([float(c) for c in v], float(t)) for v, t in zip(x, np.digitize(x[:, 0], [2.5, 5.5]), strict=True)]
    df = spark.createDataFrame(data, "a array<double>, label_idx double").select(array_to_vector("a").alias("features"), "label_idx")
    SoftmaxBoosting(3, stages=2).fit(df)
    assert [d.count() for d in seen] == [64] and seen[0].agg(F.sum("n")).first()[0] == 2000
