"""Tree learners on weighted cells against the same learners on the rows."""

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from tabforge.plans import cells as C
from tabforge.plans import train as TR


def frame(spark, x, y, classes=None):
    data = [([float(c) for c in v], float(t)) for v, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(data, "a array<double>, label_idx double").select(array_to_vector("a").alias("features"), "label_idx")
    df = df.withMetadata("label_idx", {"ml_attr": {"type": "nominal", "num_vals": classes}}) if classes else df
    return df.repartition(3).cache()


def learner(kind, classes, n, name, **p):
    return dict(TR.estimators(kind, classes, n, TR.TrainParams(rf_max_depth=5, **p)))[name]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, size=(n, 2)).astype(float)
    return x, rng.normal(size=n) + x[:, 0] * 3 - (x[:, 1] > 4) * 5


def test_cells_hold_every_row_once(spark):
    x, y = rows(3000, 1)
    c = C.cells_of(frame(spark, x, y), 3000, None, 256, least_rows=0)
    got = {tuple(r["features"]): (r["n"], r["label_idx"], r["var"]) for r in c.rows.collect()}
    assert c.count == len(got) == 64 and sum(n for n, _, _ in got.values()) == 3000
    for k, (n, mean, var) in got.items():
        own = y[(x == k).all(axis=1)]
        assert n == len(own) and np.isclose(mean, own.mean()) and np.isclose(var, own.var())


def test_features_of_many_values_fall_into_bins(spark):
    x, y = np.random.default_rng(2).normal(size=(4000, 1)), np.zeros(4000)
    c = C.cells_of(frame(spark, x, y), 4000, None, 16, least_rows=0)
    assert c.count <= 16 and sum(r["n"] for r in c.rows.collect()) == 4000


def test_rows_that_share_no_cells_are_left_as_they_are(spark):
    x = np.random.default_rng(3).normal(size=(600, 3))
    df = frame(spark, x, x[:, 0])
    assert C.cells_of(df, 600, None, 256, least_rows=0) is None and C.cells_of(df, 600, None, 2) is None


def test_boosted_trees_are_those_of_the_rows(spark):
    x, y = rows(2000, 4)
    for kind, classes, target in (("regression", 0, y), ("classification", 2, (y > 6).astype(float))):
        df = frame(spark, x, target, classes)
        est = learner(kind, classes, 2000, "Gradient Boosting", gbt_stages=5)
        c = C.cells_of(df, 2000, classes or None, 256, least_rows=0)
        grid = frame(spark, [(a, b) for a in range(8) for b in range(8)], np.zeros(64))
        by = lambda m: {tuple(r["features"]): r["prediction"] for r in m.transform(grid).collect()}
        a, b = by(est.fit(df)), by(C.fit_on_cells(est, c))
        assert all(np.isclose(a[k], b[k]) for k in a)


def test_forest_on_cells_learns_steps_and_is_saved(spark, tmp_path):
    x, _ = rows(2000, 5)
    y = np.digitize(x[:, 0], [2.5, 5.5])
    for kind, classes, target, load in (("regression", 0, np.array([10.0, 25.0, 70.0])[y], RandomForestRegressionModel),
                                        ("classification", 3, y, RandomForestClassificationModel)):
        df = frame(spark, x, target, classes)
        c = C.cells_of(df, 2000, classes or None, 256, least_rows=0)
        m = C.fit_on_cells(learner(kind, classes, 2000, "Random Forest", rf_trees=25), c)
        m.write().overwrite().save(f"{tmp_path}/{kind}")
        for model in (m, load.load(f"{tmp_path}/{kind}")):
            assert model.getNumTrees == 25
            assert model.transform(df).where(F.abs(F.col("prediction") - F.col("label_idx")) > 1e-9).count() == 0


def test_a_tree_draws_as_many_rows_as_there_are(spark):
    rows_ = spark.createDataFrame([(i, 400.0) for i in range(50)], "cell long, n double").select(C.drawn(7, 40).alias("d")).collect()
    k = np.array([r["d"]["k"] for r in rows_])
    # Poisson(400): mean and variance 400; 2,000 draws
    assert abs(k.mean() - 400) < 3 and abs(k.var() - 400) < 80


def test_train_all_grows_its_trees_on_cells(spark, monkeypatch):
    met = []
    fit = C.fit_on_cells
    monkeypatch.setattr(C, "LEAST_ROWS", 0)
    monkeypatch.setattr(TR, "cells_of", lambda *a: C.cells_of(*a, least_rows=0))
    monkeypatch.setattr(TR, "fit_on_cells", lambda est, c: met.append(c.count) or fit(est, c))
    df = spark.range(3000).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    prep, labels, lb, res = TR.train_all(spark, df, df, ["a"], "y", "classification", keys=["id"],
                                         params=TR.TrainParams(rf_trees=5, gbt_stages=3, lr_max_iter=10))
    assert met == [10, 10] and isinstance(res[2].model, GBTClassificationModel)
    assert [r.metrics["accuracy"] for r in res[1:]] == [1.0, 1.0]


def tables(spark, n=4000):
    """Rows with nulls among few different feature values, a text feature, a class and a number to learn."""
    i = F.col("id")
    df = spark.range(n).select(
        "id", F.when(i % 7 != 0, (i % 11).cast("double")).alias("a"), F.when(i % 5 != 0, F.concat(F.lit("c"), i % 3)).alias("b"),
        F.when(i % 13 < 4, "x").when((i + i % 3) % 11 < 5, "y").otherwise("z").alias("k"), ((i % 11) * 3.0 + (i * i % 17)).alias("v"))
    return df.where("id % 4 != 0"), df.where("id % 4 = 0")


def trained(spark, target, monkeypatch, cells):
    train, test = tables(spark)
    least, met = (0 if cells else 10 ** 9), []
    fit = C.fit_on_cells
    monkeypatch.setattr(TR, "alike_of", lambda *a: C.alike_of(*a, least_rows=least))
    monkeypatch.setattr(TR, "once_each", lambda *a: C.once_each(*a, least_rows=least))
    monkeypatch.setattr(TR, "fit_on_cells", lambda est, c: met.append(c.count) or fit(est, c))
    kind = "classification" if target == "k" else "regression"
    names = [TR.CLASSIFICATION_ALGORITHMS[i] if target == "k" else TR.REGRESSION_ALGORITHMS[i] for i in (0, 2)]
    prep, labels, lb, res = TR.train_all(spark, train, test, ["a", "b"], target, kind, keys=["id"], algorithms=names,
                                         params=TR.TrainParams(gbt_stages=4))
    return met, res


def test_every_model_learns_from_rows_alike_as_from_all_rows(spark, monkeypatch):
    for target in ("k", "v"):
        met, by_cells = trained(spark, target, monkeypatch, True)
        none, by_rows = trained(spark, target, monkeypatch, False)
        # nulls are filled, so 11 * 3 kinds of rows (and three classes)
        assert len(met) == 2 and met[0] <= 33 * (3 if target == "k" else 1) and none == []
        for a, b in zip(by_cells, by_rows, strict=True):
            for m in b.metrics:
                assert np.isclose(a.metrics[m], b.metrics[m], rtol=1e-6, atol=1e-6), (a.algorithm_name, m)
    assert np.allclose(by_cells[0].model.coefficients, by_rows[0].model.coefficients)


def test_rows_alike_are_scored_once_and_all_come_back(spark):
    train, test = tables(spark)
    prep = TR.FittedPrep.fit(train, ["a", "b"], "v")
    met = []

    def score(kinds, own):
        met.append(kinds.count())
        return prep.transform_test(kinds, keep=own, vector_col="features").withColumn("pred_label", F.xxhash64("features").cast("double"))

    got = C.once_each(test, prep, "v", score, ["pred_label"], least_rows=0)
    plain = prep.transform_test(test, keep=["v"], vector_col="features").select("v", F.xxhash64("features").cast("double").alias("pred_label"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and met[0] <= 33
    assert C.once_each(test, prep, "v", score, ["pred_label"]) is None


def test_rows_seldom_alike_or_without_a_target_are_left_as_they_are(spark):
    prepare = lambda some, own: TR.prepare_xy(prep, some, "y", None, own, True)
    for a, y in (((F.col("id")).cast("double"), F.col("id") * 1.0), ((F.col("id") % 4).cast("double"), F.when(F.col("id") > 0, 1.0))):
        df = spark.range(1000).select(a.alias("a"), y.alias("y"))
        prep = TR.FittedPrep.fit(df, ["a"], "y")
        assert C.alike_of(df, prep, "y", None, prepare, 256, least_rows=0) is None
