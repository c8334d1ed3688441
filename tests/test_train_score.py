"""Models by properties: separable data, known coefficients, seeds, probabilities, batch = stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.plans.experiment import run_experiment
from tabforge.plans.score import ScoringBundle
from tabforge.plans.train import TrainParams, train_all
from tabforge.operators import runlog as RL
from tabforge.streaming import score_stream as SS

FAST = TrainParams(lr_max_iter=100, rf_trees=10, rf_max_depth=5, gbt_stages=10)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        y = i % 2
        rows.append((i, float(rng.normal(3 * y, 1.0)), "u" if y else "v", float(y)))
    df = spark.createDataFrame(rows, "k long, a double, g string, y double")
    return df.withColumn("is_test", F.col("k") % 5 == 0)


def test_separable_auc_and_probabilities(spark, separable):
    tr, te = separable.where(~F.col("is_test")), separable.where(F.col("is_test"))
    prep, labels, lb, res = train_all(spark, tr, te, ["a", "g"], "y", "classification", keys=["k"], params=FAST)
    assert labels == [0.0, 1.0]
    for r in lb.collect():
        assert r["metrics"]["auc"] > 0.95 and sorted(lb.toPandas()["rank"]) == [1, 2, 3]
    b = ScoringBundle(prep, res[0].model, "classification", res[0].algorithm_name, labels, "double")
    out = b.predict_batch(te.drop("y"))
    assert out.where(~F.col("prediction").between(0, 1)).count() == 0
    assert set(out.columns) >= {"k", "a", "g", "is_test", "prediction"}


def test_same_seed_same_forest(spark, separable):
    tr, te = separable.where(~F.col("is_test")), separable.where(F.col("is_test"))
    runs = []
    for _ in range(2):
        prep, labels, lb, res = train_all(spark, tr, te, ["a", "g"], "y", "classification", keys=["k"],
                                          params=FAST, algorithms=["Random Forest"])
        b = ScoringBundle(prep, res[0].model, "classification", "Random Forest", labels, "double")
        runs.append([r["prediction"] for r in b.predict_batch(te.drop("y")).orderBy("k").collect()])
    assert runs[0] == runs[1]


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(z), float(3.0 + 2.0 * x - 0.5 * z)) for i, (x, z) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(rows, "k long, x double, z double, y double")
    prep, _, lb, res = train_all(spark, df, df, ["x", "z"], "y", "regression", params=FAST,
                                 algorithms=["Linear Regression"])
    m = res[0].model
    coef = [m.coefficients[i] / prep.stats[c][1] for i, c in enumerate(["x", "z"])]
    assert coef == pytest.approx([2.0, -0.5], abs=1e-9)
    assert lb.first()["metrics"]["r2"] == pytest.approx(1.0)


def test_multiclass_ovr_probabilities(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(i % 3, 0.3)), ["a", "b", "c"][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v double, y string").withColumn("is_test", F.col("k") % 4 == 0)
    tr, te = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    prep, labels, lb, res = train_all(spark, tr, te, ["v"], "y", "classification", keys=["k"], params=FAST,
                                      algorithms=["Gradient Boosting"])
    b = ScoringBundle(prep, res[0].model, "classification", "Gradient Boosting", labels, "string")
    out = b.predict_batch(te.drop("y"))
    tot = F.col("prob_a") + F.col("prob_b") + F.col("prob_c")
    assert out.where(F.abs(tot - 1) > 1e-9).count() == 0
    assert lb.first()["metrics"]["accuracy"] > 0.9


def test_batch_equals_stream(spark, separable, tmp_path):
    tr, te = separable.where(~F.col("is_test")), separable.where(F.col("is_test"))
    prep, labels, lb, res = train_all(spark, tr, te, ["a", "g"], "y", "classification", params=FAST,
                                      algorithms=["Logistic Regression"])
    b = ScoringBundle(prep, res[0].model, "classification", "Logistic Regression", labels, "double")
    src = str(tmp_path / "src")
    te.drop("y").write.parquet(src)
    stream = SS.read_stream(spark, src, te.drop("y").schema)
    got = SS.stream_to_table(SS.score_stream(b, stream, keep=["k"], probabilities=True))
    want = b.predict(te.drop("y"), keep=["k"], return_probabilities=True)
    assert got.count() == want.count()
    j = got.join(want.withColumnRenamed("prediction", "p2").withColumnRenamed("probabilities", "q2"), "k")
    assert j.where((F.col("prediction") != F.col("p2")) | (F.col("probabilities")["1.0"] != F.col("q2")["1.0"])).count() == 0


def test_run_experiment_writes_log(spark, separable, tmp_path):
    log = str(tmp_path / "log")
    lb = run_experiment(spark, separable.drop("is_test"), ["a", "g"], "y", "classification", keys=["k"],
                        log_dir=log, experiment_id=7, name="sep", dataset_id=1, params=FAST)
    assert lb.count() == 3
    st = RL.current_status(spark.read.parquet(f"{log}/run_events")).first()
    assert st["status"] == "completed" and st["n_events"] == 4
    models = spark.read.parquet(f"{log}/trained_models")
    assert sorted(r["rank"] for r in models.collect()) == [1, 2, 3]
    b = ScoringBundle.load(spark, models.where("rank = 1").first()["model_path"] + "_bundle")
    assert b.predict(separable.limit(5), keep=["k"]).count() == 5


def test_run_experiment_failure_is_logged(spark, separable, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(Exception):
        run_experiment(spark, separable.drop("is_test"), ["a", "missing_col"], "y", "classification", keys=["k"],
                       log_dir=log, experiment_id=8, params=FAST)
    st = RL.current_status(spark.read.parquet(f"{log}/run_events")).first()
    assert st["status"] == "failed" and "missing_col" in st["message"]


def test_attempts_count_from_their_commit_on(spark, separable, tmp_path, monkeypatch):
    """One experiment run, run again, then lost after its models were appended: the second run's models are what counts."""
    log, df = str(tmp_path / "log"), separable.drop("is_test")
    tiny = TrainParams(lr_max_iter=5, rf_trees=2, rf_max_depth=2, gbt_stages=2)

    def run():
        run_experiment(spark, df, ["a", "g"], "y", "classification", keys=["k"], log_dir=log, experiment_id=9, params=tiny)

    run()
    first = {r["model_id"] for r in RL.visible_models(spark, log).collect()}
    run()
    second = {r["model_id"] for r in RL.visible_models(spark, log).collect()}
    assert len(first) == len(second) == 3 and min(second) > max(first)

    def lost(*a):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(RL, "commit_event", lost)
    with pytest.raises(RuntimeError):
        run()
    models = spark.read.parquet(f"{log}/trained_models")
    assert models.count() == 9  # the lost attempt's rows are in the log, and nothing sees them
    seen = RL.visible_models(spark, log)
    assert {r["model_id"] for r in seen.collect()} == second
    exp = RL.current_experiments(spark.read.parquet(f"{log}/experiments"))
    assert exp.count() == 1
    assert RL.best_model_per_run(exp, seen).count() == 1
    st = RL.current_status(spark.read.parquet(f"{log}/run_events")).first()
    assert st["status"] == "failed" and "gone" in st["message"]
    assert all(ScoringBundle.load(spark, r["model_path"] + "_bundle").predict(df.limit(2)).count() == 2 for r in seen.collect())


def test_json_records_stream_equals_batch(spark, separable, tmp_path):
    import json

    from tabforge.sources.records import read_records, text_schema
    tr, te = separable.where(~F.col("is_test")), separable.where(F.col("is_test"))
    prep, labels, lb, res = train_all(spark, tr, te, ["a", "g"], "y", "classification", params=FAST,
                                      algorithms=["Logistic Regression"])
    b = ScoringBundle(prep, res[0].model, "classification", "Logistic Regression", labels, "double")
    src = tmp_path / "records"
    src.mkdir()
    recs = [{"k": str(r["k"]), "A": r["a"], "g": r["g"]} for r in te.limit(50).collect()]  # other spelling of a
    recs[0]["A"] = " 1.5 "  # number as text
    del recs[1]["g"]       # missing key
    (src / "part-0.json").write_text("\n".join(json.dumps(r) for r in recs))
    fields = ["k", "A", "g"]
    stream = SS.read_stream(spark, str(src), text_schema(fields), fmt="json")
    got = SS.stream_to_table(SS.score_stream(b, stream, keep=["k"], probabilities=True))
    want = b.predict(read_records(spark, str(src), fields), keep=["k"], return_probabilities=True)
    assert got.count() == want.count() == 50
    j = got.join(want.withColumnRenamed("prediction", "p2").withColumnRenamed("probabilities", "q2"), "k")
    assert j.where((F.col("prediction") != F.col("p2")) | (F.col("probabilities")["1.0"] != F.col("q2")["1.0"])).count() == 0
