"""Preparation against a plain-pandas restatement of the reference rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.operators.prep import UNKNOWN_CATEGORY, FittedPrep
from tabforge.plans import fixtures as fx
from conftest import SF01


def pandas_fit(train: pd.DataFrame, num, cat, y):
    st = {}
    X = train.copy()
    for c in num:
        med = X[c].median()
        st[("imp", c)] = float(med) if pd.notna(med) else 0.0
        X[c] = X[c].fillna(med)
    for c in cat:
        m = X[c].mode()
        v = m[0] if len(m) else UNKNOWN_CATEGORY
        st[("imp", c)] = v
        X[c] = X[c].fillna(v)
    for c in cat:
        enc = {k: train.loc[X[c] == k, y].mean() for k in X[c].unique()}
        st[("enc", c)] = enc
        X[c] = X[c].map(enc)
    for c in num + cat:
        mu, sd = X[c].mean(), X[c].std()
        st[("stat", c)] = (mu, sd if sd > 0 else 1.0)
        X[c] = (X[c] - mu) / sd if sd > 0 else 0.0
    return X, st


@pytest.fixture(scope="module")
def orders(spark):
    o = fx.orders_ml(spark, SF01)
    pdf = o.toPandas()
    return o, pdf


def test_fit_transform_matches_pandas(spark, orders):
    o, pdf = orders
    train = o.where(~F.col("is_test"))
    prep = FittedPrep.fit(train, ["x", "c"], "y")
    out = prep.transform_fit(train, keep=["o_orderkey"]).toPandas().set_index("o_orderkey").sort_index()
    ptrain = pdf[~pdf.is_test].set_index("o_orderkey").sort_index()
    X, st = pandas_fit(ptrain, ["x"], ["c"], "y")
    assert prep.imputation["x"] == pytest.approx(st[("imp", "x")])
    assert prep.imputation["c"] == st[("imp", "c")]
    np.testing.assert_allclose(out["x"].values, X["x"].values, atol=1e-9)
    np.testing.assert_allclose(out["c"].values, X["c"].values, atol=1e-9)
    assert prep.stats["c"][1] == pytest.approx(st[("stat", "c")][1], rel=1e-12)


def test_transform_test_and_serving_match_pandas(spark, orders):
    o, pdf = orders
    prep = FittedPrep.fit(o.where(~F.col("is_test")), ["x", "hc"], "y")
    ptrain = pdf[~pdf.is_test]
    _, st = pandas_fit(ptrain.set_index("o_orderkey"), ["x"], ["hc"], "y")
    ptest = pdf[pdf.is_test].set_index("o_orderkey").sort_index()
    enc = st[("enc", "hc")]
    unseen = float(np.mean(list(enc.values())))  # unweighted mean of the encodings
    exp_hc = (ptest.hc.fillna(st[("imp", "hc")]).map(enc).fillna(unseen) - st[("stat", "hc")][0]) / st[("stat", "hc")][1]
    got = prep.transform_test(o.where(F.col("is_test")), keep=["o_orderkey"]).toPandas().set_index("o_orderkey").sort_index()
    np.testing.assert_allclose(got["hc"].values, exp_hc.values, atol=1e-9)
    # serving: numeric null -> raw 0 before z-score (Q1), null category -> unseen default
    exp_x = (ptest.x.fillna(0.0) - st[("stat", "x")][0]) / st[("stat", "x")][1]
    srv = prep.transform_serving(o.where(F.col("is_test")).select("o_orderkey", F.col("x").alias(" X "), "hc"),
                                 keep=["o_orderkey"]).toPandas().set_index("o_orderkey").sort_index()
    np.testing.assert_allclose(srv["x"].values, exp_x.values, atol=1e-9)
    fitted = prep.transform_serving(o.where(F.col("is_test")), keep=["o_orderkey"], fill="fitted").toPandas()
    fitted = fitted.set_index("o_orderkey").sort_index()
    exp_x2 = (ptest.x.fillna(st[("imp", "x")]) - st[("stat", "x")][0]) / st[("stat", "x")][1]
    np.testing.assert_allclose(fitted["x"].values, exp_x2.values, atol=1e-9)


def test_join_paths_equal_map_path(spark, orders):
    o, _ = orders
    train, test = o.where(~F.col("is_test")), o.where(F.col("is_test"))
    base = FittedPrep.fit(train, ["x", "hc"], "y").transform_test(test, keep=["o_orderkey"])
    for kw in ({"map_max": 0}, {"map_max": 0, "broadcast_bytes": 0, "hot_share": 0.0005, "salt_buckets": 4}):
        p = FittedPrep.fit(train, ["x", "hc"], "y", **kw)
        assert p.small_encodings == {}
        other = p.transform_test(test, keep=["o_orderkey"])
        j = base.join(other.withColumnRenamed("hc", "hc2").withColumnRenamed("x", "x2"), "o_orderkey")
        assert j.count() == base.count()
        assert j.where(F.abs(F.col("hc") - F.col("hc2")) > 1e-12).count() == 0


def test_quirks_constant_all_null_bool_and_unknown(spark):
    rows = [(i, 7.0, None, i % 2 == 0, None if i % 3 == 0 else (i % 4 == 0), None, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, const double, empty double, b boolean, bn boolean, s string, y double")
    prep = FittedPrep.fit(df, ["const", "empty", "b", "bn", "s"], "y")
    assert prep.numeric_columns == ["const", "empty", "b"]  # bool without nulls is numeric
    assert prep.categorical_columns == ["bn", "s"]  # bool with nulls is categorical
    assert prep.imputation["empty"] == 0.0 and prep.imputation["s"] == UNKNOWN_CATEGORY
    assert prep.stats["const"] == [7.0, 1.0] and "const" in prep.fit_zero  # Q4: zero on train
    out = prep.transform_fit(df).first()
    assert out["const"] == 0.0 and out["empty"] == 0.0 and out["s"] == 0.0
    t = prep.transform_test(df.withColumn("const", F.lit(9.0))).first()
    assert t["const"] == 2.0  # transform: x - mean with std 1 (not forced to 0)
    assert prep.report["nulls_filled"] == 40 + 40 + 14


def test_leak_free_fit_ignores_test_rows(spark, orders):
    o, _ = orders
    train = o.where(~F.col("is_test"))
    a = FittedPrep.fit(train, ["x", "c"], "y")
    changed = o.withColumn("x", F.when(F.col("is_test"), F.lit(1e9)).otherwise(F.col("x")))
    b = FittedPrep.fit(changed.where(~F.col("is_test")), ["x", "c"], "y")
    assert a.imputation == b.imputation and a.stats == b.stats and a.small_encodings == b.small_encodings


def test_save_load_roundtrip(spark, orders, tmp_path):
    o, _ = orders
    prep = FittedPrep.fit(o.where(~F.col("is_test")), ["x", "c"], "y")
    path = str(tmp_path / "prep")
    prep.save(path)
    back = FittedPrep.load(spark, path)
    assert back.stats == prep.stats and back.imputation == prep.imputation
    a = prep.transform_test(o, keep=["o_orderkey"]).orderBy("o_orderkey").collect()
    b = back.transform_test(o, keep=["o_orderkey"]).orderBy("o_orderkey").collect()
    assert a == b


def test_frequency_encoding_for_text_target(spark, orders):
    o, pdf = orders
    prep = FittedPrep.fit(o.where(~F.col("is_test")), ["c"], "ys")
    ptrain = pdf[~pdf.is_test]
    filled = ptrain.c.fillna(ptrain.c.mode()[0])
    share = filled.value_counts() / len(filled)
    for k, v in prep.small_encodings["c"].items():
        assert v == pytest.approx(share[k], rel=1e-12)
    assert not math.isnan(prep.stats["c"][0])


def test_bool_kind_follows_the_whole_table(spark):
    rows = [(i, (i % 2 == 0) if i % 10 != 3 else None, float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, b boolean, y double")
    train = df.where("k % 10 <> 3")  # the nulls are all on the held-out side
    assert FittedPrep.fit(train, ["b"], "y").numeric_columns == ["b"]
    assert FittedPrep.fit(train, ["b"], "y", kind_source=df).categorical_columns == ["b"]


def test_map_budget_splits_columns_and_survives_save(spark, orders, tmp_path):
    o, _ = orders
    train, test = o.where(~F.col("is_test")), o.where(F.col("is_test"))
    base = FittedPrep.fit(train, ["x", "c", "hc"], "y").transform_test(test, keep=["o_orderkey"])
    p = FittedPrep.fit(train, ["x", "c", "hc"], "y", map_total_max=5)
    assert list(p.small_encodings) == ["c"] and "hc" in p.hot_categories
    path = str(tmp_path / "mixed")
    p.save(path)
    back = FittedPrep.load(spark, path)
    assert list(back.small_encodings) == ["c"]
    for q in (p, back):
        other = q.transform_test(test, keep=["o_orderkey"]).select(
            "o_orderkey", *[F.col(c).alias(c + "2") for c in ("x", "c", "hc")])
        j = base.join(other, "o_orderkey")
        assert j.count() == base.count()
        assert j.where(sum(F.abs(F.col(c) - F.col(c + "2")) for c in ("x", "c", "hc")) > 1e-12).count() == 0
