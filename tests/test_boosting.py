"""Multiclass boosting on the joint loss against a plain version, one-vs-rest, and its own saved form."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabforge.plans.boosting import SoftmaxBoosting, SoftmaxBoostModel


def rows(n, seed, noise=0.6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.digitize(x[:, 0] + 0.5 * np.abs(x[:, 1]) + rng.normal(size=n) * noise, [-0.4, 0.6])
    return x, y


def frame(spark, x, y):
    data = [(int(k), [float(c) for c in v], float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "k long, a array<double>, label_idx double")
    return df.select("k", array_to_vector("a").alias("features"), "label_idx")


def plain(x, y, n_classes, stages, step):
    """Stumps on every threshold that halves between neighbours, Newton leaves, softmax loss."""
    onehot = np.eye(n_classes)[y]
    scores = np.tile(np.log(onehot.mean(axis=0)), (len(x), 1))
    losses = []
    for _ in range(stages):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        for c in range(n_classes):
            r, best = onehot[:, c] - p[:, c], (-1, None)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= t
                    gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum()
                    best = max(best, (gain, (f, t)), key=lambda b: b[0])
            f, t = best[1]
            for side in (x[:, f] <= t, x[:, f] > t):
                scores[side, c] += step * (n_classes - 1) / n_classes * r[side].sum() / (np.abs(r[side]) * (1 - np.abs(r[side]))).sum()
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), losses


def test_stumps_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(400, 2)).astype(float)
    y = np.digitize(x[:, 0] + rng.normal(size=400) * 2, [4, 8])
    df = frame(spark, x, y)
    model = SoftmaxBoosting(3, stages=5, depth=1, step=0.3).fit(df)
    got = np.array([r["p"] for r in model.transform(df).orderBy("k").select(vector_to_array("probability").alias("p")).collect()])
    want, losses = plain(x, y, 3, 5, 0.3)
    assert np.allclose(got, want, atol=1e-9) and np.allclose(model.losses[:5], losses, atol=1e-9)


@pytest.fixture(scope="module")
def fitted(spark):
    df = frame(spark, *rows(1500, 1)).repartition(4).cache()
    return df, SoftmaxBoosting(3, stages=25).fit(df)


def test_loss_falls_with_every_stage(fitted):
    losses = fitted[1].losses
    assert len(losses) == 26 and all(b < a for a, b in zip(losses, losses[1:], strict=False))


def test_no_worse_than_one_against_the_rest(spark, fitted):
    df, model = fitted
    held = frame(spark, *rows(1500, 2))
    other = OneVsRest(classifier=GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.1, seed=42, labelCol="label_idx", featuresCol="features"),
                      labelCol="label_idx", featuresCol="features").fit(df)
    right = lambda m: m.transform(held).where("prediction = label_idx").count()
    assert right(model) >= right(other) - 15  # a hundredth of the rows
    p = model.transform(held).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-12 and r["p"].index(max(r["p"])) == r["prediction"] for r in p)


def test_saved_model_scores_alike(spark, fitted, tmp_path):
    df, model = fitted
    model.write().overwrite().save(f"{tmp_path}/m")
    back = SoftmaxBoostModel.load(f"{tmp_path}/m")
    both = model.transform(df).select("k", "probability").join(back.transform(df).select("k", F.col("probability").alias("q")), "k")
    assert both.where("probability <> q").count() == 0 and back.losses == model.losses


def test_a_class_without_rows_and_constant_features(spark):
    x, y = np.ones((30, 2)), np.arange(30) % 2
    model = SoftmaxBoosting(3, stages=2).fit(frame(spark, x, y))
    p = np.array([r["p"] for r in model.transform(frame(spark, x, y)).select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(p[:, :2], 0.5, atol=1e-6) and (p[:, 2] < 1e-6).all()
