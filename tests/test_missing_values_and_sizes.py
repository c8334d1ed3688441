"""NaN as missing, odd texts and names, and sizes at which plans used to break."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabforge.functions.exprs import last_of_each_name, try_double
from tabforge.operators import metrics as M
from tabforge.operators import profile as prof
from tabforge.operators import schema as S
from tabforge.operators.prep import FittedPrep
from tabforge.operators.selection import exact_medians
from tabforge.plans.train import TrainParams, label_index, train_all
from tabforge.sources import csv as csvsrc

NAN = float("nan")


def test_nan_row_and_null_row_give_the_same_fit(spark):
    rows = [(1.0, "a", 1.0), (2.0, "b", 0.0), (3.0, "a", 1.0), (4.0, "b", 0.0)]
    fits = [FittedPrep.fit(spark.createDataFrame([*rows, (miss, "a", 1.0)], "x double, c string, y double"), ["x", "c"], "y") for miss in (NAN, None)]
    assert fits[0].imputation == fits[1].imputation and fits[0].stats == fits[1].stats
    assert fits[0].report["nulls_filled"] == fits[1].report["nulls_filled"] == 1 and not fits[0].fit_zero
    new = spark.createDataFrame([(NAN, "a"), (None, "a")], "x double, c string")
    for out in (fits[0].transform_serving(new, keep=[]), fits[0].transform_test(new)):
        assert len({tuple(r) for r in out.collect()}) == 1


def test_nan_in_profile_and_target(spark):
    df = spark.createDataFrame([(1, NAN, 1.0), (2, 2.0, NAN), (3, None, None)], "k int, x double, y double")
    got = {r["column"]: (r["unique_count"], r["null_count"]) for r in prof.counts(df).collect()}
    assert got["x"] == (1, 2) and prof.sample_rows(df, ["k"])["x"] == ["2.0"]
    kept, n, gone = S.drop_null_target(df, "y")
    assert (kept.count(), n, gone) == (1, 3, 2)


def test_number_texts(spark):
    texts = ["12F", "12D", "0x1p3", "1_0", " 1.5 ", "-2e3", ".5", "5.", "inf", "-Infinity", "nan", "", None, "1e400x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(try_double(F.col("t"))).collect()]
    assert got == [None, None, None, None, 1.5, -2000.0, 0.5, 5.0, float("inf"), float("-inf"), None, None, None, None]
    kinds = csvsrc.infer_types(spark.createDataFrame([("12F", "3", "1.5"), ("12D", "4", "NaN")], "seat string, n string, x string")).dtypes
    assert kinds == [("seat", "string"), ("n", "bigint"), ("x", "double")]


def test_boolean_text_for_a_boolean_feature(spark):
    p = FittedPrep.fit(spark.createDataFrame([(True, 1.0), (False, 0.0), (True, 1.0)], "b boolean, y double"), ["b"], "y")
    real = [r[0] for r in p.transform_serving(spark.createDataFrame([(True,), (False,)], "b boolean"), keep=[]).collect()]
    text = [r[0] for r in p.transform_serving(spark.createDataFrame([("true",), ("False",)], "b string"), keep=[]).collect()]
    assert real == text and real[0] != real[1]


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, b int")
    assert last_of_each_name(df).columns == ["A", "b"] and last_of_each_name(df).first()["A"] == 2
    assert S.align_columns(df, ["a", "b"]).first().asDict() == {"a": 2, "b": 3}
    out = S.attach_prediction(spark.createDataFrame([(1, "old")], "k int, Prediction string"), F.lit(7))
    assert out.columns == ["k", "prediction"]


def test_auc_with_huge_weights_and_many_buckets(spark):
    df = spark.createDataFrame([(1, 0.9, 4_000_000_000), (0, 0.1, 4_000_000_000), (1, 0.1, 4_000_000_000)], "y int, s double, w long")
    assert abs(M.auc(df, F.col("y"), F.col("s"), weight=F.col("w")).first()["auc"] - 0.75) < 1e-12
    many = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.hash("id") % 20_000).cast("double").alias("s"))
    whole = M.auc(many, F.col("y"), F.col("s")).first()
    cut = M.auc(many, F.col("y"), F.col("s"), max_scores_per_task=8).first()  # over 2,000 buckets
    assert abs(whole["auc"] - cut["auc"]) < 1e-9 and (whole["pos"], whole["neg"]) == (cut["pos"], cut["neg"])


def test_more_than_a_thousand_labels(spark):
    df = spark.range(2_400).select("id", (F.col("id") % 1_200).alias("y"), (F.col("id") % 1_200).cast("double").alias("x"))
    assert label_index(df, "y") == list(range(1_200))
    _, labels, board, done = train_all(spark, df, df, ["x"], "y", "classification", algorithms=["Random Forest"],
                                       params=TrainParams(rf_trees=1, rf_max_depth=3, max_bins=32))
    assert len(labels) == 1_200 and board.count() == 1


def test_medians_read_the_table_once(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    n = {c: df.count() for c in df.columns}
    want = exact_medians(df, n)
    sc = spark.sparkContext
    sc.setJobGroup("medians", "medians")
    got = exact_medians(df, n, max_bracket=500)
    jobs = len(sc.statusTracker().getJobIdsForGroup("medians"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs <= 12


def test_sparse_columns_share_one_sample_job(spark):
    cols = [F.when(F.col("id") % 1_000 == k, F.col("id")).alias(f"c{k}") for k in range(20)]
    df = spark.range(5_000).select("id", *cols)
    sc = spark.sparkContext
    sc.setJobGroup("samples", "samples")
    got = prof.sample_rows(df, ["id"])
    jobs = len(sc.statusTracker().getJobIdsForGroup("samples"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got["c7"] == [str(7 + 1_000 * k) for k in range(5)] and jobs <= 4


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from tabforge import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
