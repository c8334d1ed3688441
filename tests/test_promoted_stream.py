"""Stream scoring by the model in charge: promotions between and inside batches, repeated batches, malformed records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tabforge.operators import runlog as RL
from tabforge.plans.score import ScoringBundle
from tabforge.plans.train import train_all
from tabforge.streaming import promoted_stream as PS
from tabforge.streaming.score_stream import read_stream

T0 = dt.datetime(2024, 3, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Two committed models (2x and 10 - x) and one of an attempt that never committed."""
    base = str(tmp_path_factory.mktemp("promo"))
    df = spark.range(40).select((F.col("id") * 1.0).alias("x"))
    for i, y in ((1, F.col("x") * 2), (2, 10 - F.col("x")), (3, F.col("x") * 100)):
        prep, labels, lb, res = train_all(spark, df.withColumn("y", y), df.withColumn("y", y), ["x"], "y", "regression",
                                          algorithms=["Linear Regression"])
        ScoringBundle(prep, res[0].model, "regression", "Linear Regression").save(f"{base}/m{i}_bundle")
        RL.append(spark.createDataFrame([(i, 5, "Linear Regression", f"{base}/m{i}", {}, 0.0, 1, T0, "gone" if i == 3 else "ok")], RL.MODELS),
                  f"{base}/trained_models")
    RL.append(RL.commit_event(spark, 5, "ok", 4), f"{base}/run_events")
    return base


def promote(spark, log, model, hour, on=True, seq=0):
    RL.append(spark.createDataFrame([(5, model, "promote", None, on, False, None, at(hour), seq, None)], RL.EVENTS), f"{log}/run_events")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"k": k, "at": at(h).isoformat(), "record": rec}) for k, h, rec in rows) + "\n")


def test_follows_promotions(spark, log, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    stream = lambda: read_stream(spark, str(src), "k bigint, at timestamp_ntz, record string", fmt="json")
    scorer = PS.PromotedScorer(spark, log, 5, out, event_time="at")
    put(src, "a.json", [(1, 0, '{"x": "3"}'), (2, 5, '{"x": 4}')])
    PS.run_promoted(scorer, stream(), str(tmp_path / "ck"))  # before any promotion: nobody is in charge
    promote(spark, log, 1, 2)
    promote(spark, log, 3, 3)  # of an attempt that never committed: counts for nothing
    promote(spark, log, 2, 6)
    promote(spark, log, 2, 9, on=False)
    put(src, "b.json", [(3, 5, '{"x": 4}'), (4, 6, '{"x": 4}'), (5, 7, '{"x'), (6, 2, '{"x": " 1.5 "}'), (7, 8, None), (8, 9, '{"x": 1}'),
                        (9, 1, '{"x": 1}'), (10, 7, "[1]"), (11, 7, '{"X": 1, "z": 2}')])
    PS.run_promoted(scorer, stream(), str(tmp_path / "ck"))
    got = {r["k"]: (round(float(r["prediction"]), 6), r["model_id"]) for r in spark.read.parquet(f"{out}/scored").collect()}
    assert got == {3: (8.0, 1), 4: (6.0, 2), 6: (3.0, 1), 11: (got[11][0], 2)}
    bad = {r["k"]: r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert bad == {1: PS.NO_MODEL, 2: PS.NO_MODEL, 8: PS.NO_MODEL, 9: PS.NO_MODEL, 5: PS.BAD_JSON, 7: PS.BAD_JSON, 10: PS.BAD_JSON}
    # a batch that runs twice leaves its rows once
    b = spark.read.schema("k bigint, at timestamp_ntz, record string").json(str(src / "b.json"))
    scorer(b, 1)
    assert spark.read.parquet(f"{out}/scored").count() == 4 and spark.read.parquet(f"{out}/rejected").count() == 7
    # without an event time the log as it is now decides: nobody since hour 9
    PS.PromotedScorer(spark, log, 5, str(tmp_path / "now"))(b, 0)
    assert spark.read.parquet(str(tmp_path / "now/rejected")).count() == 9


def test_tenures(spark):
    m = spark.createDataFrame([(1,), (2,)], "model_id bigint")
    ev = [(5, 1, "promote", None, True, False, None, at(1), 0, None), (5, 2, "promote", None, True, False, None, at(1), 1, None),
          (5, 1, "promote", None, False, True, None, at(2), 0, None), (6, 1, "promote", None, True, True, None, at(0), 0, None)]
    assert PS.tenures(spark.createDataFrame(ev, RL.EVENTS), m, 5) == [(2, at(1), None)]
    assert PS.tenures(spark.createDataFrame(ev[:0], RL.EVENTS), m, 5) == []
