"""Promotion state against a sequential replay of the reference's update rule."""

import random

from tabforge.operators import runlog as RL


def replay(models, events):
    state = {m: [False, False] for m, _ in models}
    exp_of = dict(models)
    for e, m, api, batch, _seq in sorted(events, key=lambda t: t[4]):
        for other, ex in models:
            if ex == e and other != m:
                if api:
                    state[other][0] = False
                if batch:
                    state[other][1] = False
        state[m] = [api, batch]
        assert exp_of[m] == e
    return state


def test_promotion_matches_replay(spark):
    rnd = random.Random(5)
    models = [(i, i % 4) for i in range(20)]
    events = []
    for seq in range(60):
        m = rnd.randrange(20)
        events.append((m % 4, m, rnd.random() < 0.5, rnd.random() < 0.5, seq))
    md = spark.createDataFrame(models, "model_id bigint, experiment_id bigint")
    ev = spark.createDataFrame([(e, m, "promote", None, a, b, None, None, s, None) for e, m, a, b, s in events], RL.EVENTS)
    got = {r["model_id"]: [r["is_deployed_api"], r["is_deployed_batch"]]
           for r in RL.promotion_state(md, ev).collect()}
    assert got == replay(models, events)


def test_cascade_and_status(spark):
    ds = spark.createDataFrame([(1, "a"), (2, "b")], "dataset_id bigint, name string")
    ex = spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "experiment_id bigint, dataset_id bigint")
    mo = spark.createDataFrame([(100, 10), (101, 11), (102, 12)], "model_id bigint, experiment_id bigint")
    tb = spark.createDataFrame([("dataset", 1), ("experiment", 12)], "kind string, id bigint")
    d2, e2, m2 = RL.purge_cascade(ds, ex, mo, tb)
    assert sorted(r[0] for r in m2.select("model_id").collect()) == [101]
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, None, "status", "pending", None, None, None, t0, 0, None),
                                (1, None, "status", "failed", None, None, "boom", t0, 2, None),
                                (1, None, "status", "training", None, None, None, t0, 1, None)], RL.EVENTS)
    r = RL.current_status(ev).first()
    assert (r["status"], r["message"], r["n_events"]) == ("failed", "boom", 3)


def test_promote_gate_and_batch_lookup(spark, tmp_path):
    from tabforge.plans.score import batch_summary_frame
    import pytest
    models = spark.createDataFrame([(1, 10), (2, 10)], "model_id bigint, experiment_id bigint")
    ev = RL.promote_event(spark, 10, 1, True, False, 1).unionByName(RL.promote_event(spark, 10, 2, False, True, 2))
    state = RL.promotion_state(models, ev)
    RL.check_deployed(state, 2, "is_deployed_batch")
    with pytest.raises(PermissionError):
        RL.check_deployed(state, 1, "is_deployed_batch")
    with pytest.raises(LookupError):
        RL.check_deployed(state, 3)
    log = str(tmp_path / "log")
    data = str(tmp_path / "res")
    spark.range(12).write.parquet(data)
    batch_summary_frame(spark, {"result_id": "r1", "path": data, "num_rows": 12}).write.parquet(f"{log}/batch_results")
    row, rows = RL.batch_result(spark, log, "r1")
    assert row["num_rows"] == 12 and rows.limit(10).count() == 10
    assert RL.batch_result(spark, log, "nope") == (None, None)
