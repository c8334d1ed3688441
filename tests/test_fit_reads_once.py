"""The preparation's passes share one reading of the training rows."""

from pyspark.sql import functions as F

from tabforge.operators.prep import FittedPrep
from tabforge.plans import train as TR


def test_fit_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return float(v)

    df = spark.range(500).select(counted("id").alias("a"), (F.col("id") % 2).cast("double").alias("y"), F.lit("z").alias("c"))
    FittedPrep.fit(df, ["a", "c"], "y")
    assert read.value == 500


def test_training_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return float(v)

    plain = spark.range(500).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    train = spark.range(500).select(counted("id").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    TR.train_all(spark, train, plain, ["a"], "y", "classification", algorithms=["Logistic Regression"], params=TR.TrainParams(lr_max_iter=5))
    assert read.value == 500
