import pytest
from pyspark.sql import functions as F

from tabforge.operators import profile as prof
from tabforge.operators.prep import FittedPrep
from tabforge.operators.schema import kinds_frame


def test_sample_fallback_for_columns_null_at_the_head(spark):
    rows = [(i, None if i < 100 else f"v{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, late string, n int").repartition(4)
    got = prof.sample_rows(df, key=["k"], k=5, head_rows=64)
    assert got["late"] == [f"v{i}" for i in range(100, 105)]
    assert got["n"] == ["0", "1", "2", "3", "4"]


def test_approx_options_stay_close(spark):
    df = spark.range(20000).select((F.col("id") % 997).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    import numpy as np
    want = float(np.median(np.arange(20000) % 997))
    exact = FittedPrep.fit(df, ["x"], "y")
    approx = FittedPrep.fit(df, ["x"], "y", median="approx")
    assert exact.imputation["x"] == want
    assert approx.imputation["x"] == pytest.approx(want, abs=5)
    a = {r["column"]: r["unique_count"] for r in prof.counts(df, approx=True).collect()}
    assert a["x"] == pytest.approx(997, rel=0.15)  # rsd 0.05 is one standard deviation


def test_pandas_dtype_names(spark):
    df = spark.createDataFrame([(1, None, True), (2, 3, False)], "a bigint, b int, c boolean")
    k = {r["name"]: (r["kind"], r["pandas_dtype"]) for r in kinds_frame(df).collect()}
    assert k == {"a": ("numeric", "int64"), "b": ("numeric", "float64"), "c": ("numeric", "bool")}


def test_sample_text_of_doubles_matches_python_str(spark):
    vals = [12345678.9, 1e7, 0.0001, 1e-5, 1e16, 123.45, -2.5e-9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, v double")
    got = prof.sample_rows(df, key=["k"], k=10)["v"]
    assert got == [str(v) for v in vals]
