"""Quirks Q5 and Q9 of SURVEY 2.12 (the others are covered next to their operators)."""

from pyspark.sql import functions as F

from tabforge.operators import profile as prof
from tabforge.plans.score import ScoringBundle
from tabforge.plans.train import TrainParams, train_all


def test_q5_leak_warning_for_near_unique_columns(spark):
    df = spark.createDataFrame([(f"name{i}", "a" if i % 2 else "b", i % 2) for i in range(200)],
                               "name string, cat string, y int")
    p = prof.profile_table(df)
    assert [r["name"] for r in prof.leak_warnings(p, 200).collect()] == ["name"]


def test_q9_integer_class_names_stay_integers(spark):
    rows = [(i, float(i % 7), int(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v double, y int").withColumn("is_test", F.col("k") % 5 == 0)
    tr, te = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    prep, labels, lb, res = train_all(spark, tr, te, ["v"], "y", "classification",
                                      params=TrainParams(lr_max_iter=50), algorithms=["Logistic Regression"])
    assert labels == [0, 1]
    b = ScoringBundle(prep, res[0].model, "classification", "Logistic Regression", labels, "int")
    m = b.predict(te, keep=["k"], return_probabilities=True).first()
    assert sorted(m["probabilities"].keys()) == ["0", "1"] and m["prediction"] in (0, 1)
    assert isinstance(m["prediction"], int)
