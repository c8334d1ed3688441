"""Digit selection: the order key, ties, nulls, infinities, signed zeros, far-apart ranks, and the number of passes."""

import datetime as dt
import decimal
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators import selection as S

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308,
         math.inf, -math.inf, 1.0, 1.0 - 2.0 ** -53, 1.0 + 2.0 ** -52, 0.1, -0.1, 3.0, 1e22, 1e-300]


def test_double_key_is_the_ieee_form(spark):
    rng = np.random.default_rng(5)
    xs = EDGES + [s * 2.0 ** e for e in range(-1074, 1024) for s in (1.0, -1.0)]
    xs += [math.nextafter(2.0 ** e, to) for e in range(-1073, 1024) for to in (0.0, math.inf)]
    xs += np.frombuffer(rng.integers(0, 1 << 63, 20_000).astype("<i8").tobytes(), "<f8")[:20_000].tolist()
    xs = [x for x in xs if not math.isnan(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.order_key(F.col("x"), T.DoubleType()).alias("k")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits), r
        assert S.key_value(r["k"], T.DoubleType()) == r["x"]


def test_far_apart_ranks_of_distinct_values(spark):
    n = 5_000_000
    df = spark.range(n).select(((F.col("id") * 2654435761) % n * 0.37 - 1000.0).alias("v"))
    got = S.kth_values(df, {"v": [0, n - 1, n // 2]}, {"v": n})
    assert got["v"] == {r: r * 0.37 - 1000.0 for r in (0, n // 2, n - 1)}


def test_edges_ties_and_nulls(spark):
    xs = EDGES * 3 + [None] * 40 + [1.0] * 500 + [math.nan] * 2
    live = sorted((x for x in xs if x is not None and not math.isnan(x)))
    df = spark.createDataFrame([(x, None if x is None or math.isnan(x) or math.isinf(x) else int(max(-9e18, min(9e18, x)))) for x in xs], "v double, w long").repartition(4)
    n = len(live) + 2
    got = S.kth_values(df, {"v": [*range(0, n - 2, 9), n - 3, n - 2, n - 1]}, {"v": n})["v"]
    assert all(got[r] == live[r] for r in [*range(0, n - 2, 9), n - 3]) and all(math.isnan(got[r]) for r in (n - 2, n - 1))
    ws = sorted(r["w"] for r in df.where("w IS NOT NULL").collect())
    assert S.kth_values(df, {"w": [0, len(ws) - 1, 7], "v": [2]}, {"w": len(ws), "v": n}) == {
        "w": {0: ws[0], 7: ws[7], len(ws) - 1: ws[-1]}, "v": {2: live[2]}}
    assert S.kth_values(df, {"v": [n, -1]}, {"v": n}) == {} and S.kth_values(df.limit(0), {"v": [0]}, {"v": 0}) == {}


@pytest.mark.parametrize("kind, values", [
    ("tinyint", [-128, 127, 0, 5]), ("bigint", [-(1 << 63), (1 << 63) - 1, 0, -1, 1]), ("boolean", [True, False, True]),
    ("float", [1.5, -2.25, math.inf, 0.0]), ("date", [dt.date(1960, 1, 2), dt.date(2026, 5, 1), dt.date(1970, 1, 1)]),
    ("timestamp", [dt.datetime(1969, 12, 31, 23, 0, 0, 5), dt.datetime(2026, 5, 1, 3, 4, 5, 999_999)]),
    ("timestamp_ntz", [dt.datetime(1969, 12, 31, 23, 0, 0, 5), dt.datetime(2026, 5, 1, 3, 4, 5, 999_999)]),
    ("decimal(18,4)", [decimal.Decimal("-99999999999999.9999"), decimal.Decimal("0.0001"), decimal.Decimal("99999999999999.9999")])])
def test_types(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
    n = len(values)
    assert list(S.kth_values(df, {"v": list(range(n))}, {"v": n})["v"].values()) == sorted(values)


def test_text_has_no_key(spark):
    with pytest.raises(TypeError):
        S.kth_values(spark.createDataFrame([("a",)], "v string"), {"v": [0]}, {"v": 1})


@pytest.mark.parametrize("ranks, passes", [([5], 4), (list(range(40)), 6)])
def test_passes_do_not_depend_on_the_data(spark, monkeypatch, ranks, passes):
    done = []
    real = S._narrowed
    monkeypatch.setattr(S, "_narrowed", lambda *a: done.append(1) or real(*a))
    for df in (spark.range(1000).select(F.lit(3.0).alias("v")), spark.range(1000).select(F.exp(F.col("id") / 2.0).alias("v")),
               spark.range(1000).select((1.0 + F.col("id") * 2.0 ** -52).alias("v"))):
        done.clear()
        want = sorted(r["v"] for r in df.collect())
        assert S.kth_values(df, {"v": ranks}, {"v": 1000})["v"] == {r: want[r] for r in ranks}
        assert len(done) == passes


def test_passes_read_keys_worked_out_once_and_in_steps(spark, monkeypatch):
    met, narrowed = [], S._narrowed
    monkeypatch.setattr(S, "DEFAULT_MAX_BRACKET", 0)  # keys of more rows than that are stored
    monkeypatch.setattr(S, "_narrowed", lambda keyed, *a: met.append((keyed, keyed.storageLevel.useMemory)) or narrowed(keyed, *a))
    xs = [(float("nan"), 1.0), (-0.0, None), (5e-324, -2.5), (-1.7e308, float("inf")), (None, 3.0)]
    df = spark.createDataFrame(xs, "a double, b double")
    assert S.kth_values(df, {"a": [0, 2], "b": [0, 3]}, {"a": 4, "b": 4}) == {"a": {0: -1.7e308, 2: 5e-324}, "b": {0: -2.5, 3: float("inf")}}
    # one logarithm a column, in a stored table that every pass reads
    assert len(met) == 4 and all(k is met[0][0] and stored for k, stored in met)
    assert met[0][0]._jdf.queryExecution().optimizedPlan().toString().upper().count("LOG2") == 2
    keys = S.order_keys(df, ["a", "b"], {c: T.DoubleType() for c in "ab"}).collect()
    want = df.select(*[S.order_key(F.col(c), T.DoubleType()).alias(c) for c in "ab"]).collect()
    assert [tuple(r) for r in keys] == [tuple(r) for r in want]


def test_medians_of_few_different_values_need_no_digit_passes(spark, monkeypatch):
    df = spark.range(3001).select((F.col("id") % 10).cast("double").alias("a"), F.sqrt(F.col("id").cast("double")).alias("b"))
    asked = []
    kth = S.kth_values
    monkeypatch.setattr(S, "kth_values", lambda d, ranks, *a, **k: asked.append(sorted(ranks)) or kth(d, ranks, *a, **k))
    got = S.exact_medians(df, {"a": 3001, "b": 3001}, max_bracket=100, about={"a": 10, "b": 3000})
    assert asked == [["b"]] and got["a"] == 4.0 and got["b"] == 1500 ** 0.5
