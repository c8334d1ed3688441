import math

import numpy as np

from tabforge.operators.selection import exact_medians, kth_values, median_ranks
from tabforge.operators.split import exact_holdout_flag, split_hash, holdout_flag
from tabforge.plans import fixtures as fx
from conftest import SF01


def test_kth_values_iterative_bracket_matches_sort(spark):
    rng = np.random.default_rng(7)
    xs = rng.normal(size=20000).round(3).tolist() + [5.0] * 7000  # heavy tie on one value
    df = spark.createDataFrame([(float(x),) for x in xs], "v double").repartition(8)
    ranks = [0, 1, 9999, 13500, 26999]
    got = kth_values(df, {"v": ranks}, {"v": len(xs)}, accuracy=100, max_bracket=500)
    srt = sorted(xs)
    assert got["v"] == {r: srt[r] for r in ranks}


def test_exact_medians_even_odd_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (10.0, 1.0), (4.0, 2.0)], "a double, b double")
    med = exact_medians(df, {"a": 4, "b": 3})
    assert med == {"a": 3.0, "b": 2.0}
    assert median_ranks(4) == [1, 2] and median_ranks(3) == [1]


def test_hash_split_is_stateless_and_about_20pct(spark):
    li = fx.lineitem_ml(spark, SF01)
    n_test = li.where("is_test").count()
    assert 0.18 < n_test / li.count() < 0.22
    # partition-independent: the same flag after a reshuffle
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_test")
    b = a.repartition(3, "l_partkey")
    assert a.exceptAll(b).count() == 0


def test_exact_split_size(spark):
    o = fx.table(spark, SF01, "orders").select("o_orderkey")
    flag = exact_holdout_flag(o, ["o_orderkey"], seed=42, test_fraction=0.2, max_bracket=100, accuracy=50)
    n = o.count()
    assert o.where(flag).count() == math.ceil(0.2 * n)
    train, test = split_hash(o, ["o_orderkey"])
    assert train.count() + test.count() == n
    assert o.where(holdout_flag(o, ["o_orderkey"])).count() == test.count()


def test_kth_values_two_columns_narrow_together(spark):
    rng = np.random.default_rng(9)
    a = rng.exponential(3.0, 15000).round(4)
    b = rng.integers(0, 50, 15000).astype(float)  # few distinct values, heavy ties
    b_null = np.arange(15000) % 4 == 0
    rows = [(float(x), None if m else float(y)) for x, y, m in zip(a, b, b_null)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    nb = int((~b_null).sum())
    med = exact_medians(df, {"a": 15000, "b": nb}, accuracy=50, max_bracket=300)
    assert med["a"] == float(np.median(a)) and med["b"] == float(np.median(b[~b_null]))
    got = kth_values(df, {"a": [0, 14999], "b": [nb - 1]}, {"a": 15000, "b": nb}, accuracy=50, max_bracket=300)
    assert got["a"] == {0: float(a.min()), 14999: float(a.max())}
    assert got["b"] == {nb - 1: float(b[~b_null].max())}


def test_kth_values_stops_on_few_distinct_values(spark):
    # 40k rows but only 3 distinct values: the bracket cannot shrink below max_bracket rows, the
    # distinct estimate ends the narrowing and the grouped final step answers exactly
    rows = [(float(i % 3),) for i in range(40000)]
    df = spark.createDataFrame(rows, "v double")
    got = kth_values(df, {"v": [0, 20000, 39999]}, {"v": 40000}, accuracy=50, max_bracket=100)
    assert got["v"] == {0: 0.0, 20000: 1.0, 39999: 2.0}
