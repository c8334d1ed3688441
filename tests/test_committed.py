"""Committed writes: facts observed by the write, nothing visible before the commit, reruns, empty results."""

import pytest
from pyspark.sql import functions as F

from tabforge.sources import committed as CM


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_facts_and_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    rows = [(1, "007", 1.5), (2, "a\n\"b\", c", None), (3, None, -2.0)]
    df = spark.createDataFrame(rows, "k bigint, t string, v double").repartition(3)
    done = CM.write_committed(df, path, fmt, ["v", "t"])
    assert done.num_rows == 3
    want = {"line_breaks": 1.0, "nulls:v": 1.0, "min:v": -2.0, "max:v": 1.5, "mean:v": -0.25, "nulls:t": 1.0}
    assert done.facts == want
    back = CM.read_committed(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_empty_result(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    done = CM.write_committed(spark.range(5).where("id > 9").withColumn("v", F.col("id") * 1.0), path, fmt, ["v"])
    assert done.num_rows == 0
    assert CM.read_committed(spark, path).collect() == []
    nothing = spark.createDataFrame([], "id bigint, v double")
    assert CM.write_committed(nothing, path, fmt, ["v"]).num_rows == 0


def test_failed_attempt_is_not_visible(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        CM.write_committed(bad, path)
    assert CM.last_commit(spark, path) is None
    with pytest.raises(FileNotFoundError):
        CM.read_committed(spark, path)
    CM.write_committed(spark.range(7), path)
    with pytest.raises(Exception):
        CM.write_committed(bad, path)
    # files of an attempt that ended without a commit row count for nothing either
    spark.range(1000).write.parquet(f"{path}/rows/orphan")
    assert CM.read_committed(spark, path).count() == 7
    CM.write_committed(spark.range(9), path)  # run again: the newest commit is the result
    assert CM.read_committed(spark, path).count() == 9


def test_one_scan(spark, tmp_path):
    """The rows are scanned once: a counter in the scan sees each row one time."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    df = spark.range(200, numPartitions=4).select(F.udf(look, "bigint")("id").alias("id"))
    assert CM.write_committed(df, str(tmp_path / "o"), "parquet", ["id"]).facts["max:id"] == 199.0
    assert seen.value == 200


def test_fresh_model_scores_after_an_observed_write(spark, tmp_path):
    """A model just fitted (not loaded) scores through a committed write, and again after it."""
    from tabforge.plans.score import ScoringBundle, batch_job
    from tabforge.plans.train import TrainParams, train_all
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    prep, labels, lb, res = train_all(spark, df, df, ["a"], "y", "classification", algorithms=["Logistic Regression"],
                                      params=TrainParams(lr_max_iter=20))
    b = ScoringBundle(prep, res[0].model, "classification", "Logistic Regression", labels, "int")
    for i in range(2):
        done = batch_job(spark, b, df.drop("y"), str(tmp_path / f"o{i}"), log_dir=str(tmp_path / "log"))
        assert done["num_rows"] == 300 and done["preview"].count() == 10
    assert b.predict(df.drop("y")).count() == 300
    assert spark.read.parquet(str(tmp_path / "log/batch_results")).count() == 2
