"""Scoring payload {"data": [...], "return_probabilities": bool} with the awkward record variants."""

import json


from tabforge.operators.prep import FittedPrep
from tabforge.sources.records import explode_payload, parse_all_records, read_records


def test_payload_variants_score_like_serving(spark):
    train = spark.createDataFrame([(1.0, "female", 30.0, 1.0), (3.0, "male", 22.0, 0.0), (1.0, "male", 40.0, 1.0),
                                   (2.0, "female", None, 0.0), (3.0, "male", 25.0, 0.0)],
                                  "Pclass double, Sex string, Age double, y double")
    prep = FittedPrep.fit(train, ["Pclass", "Sex", "Age"], "y")
    payload = {"data": [
        {"Pclass": 1, "Sex": "female", "Age": 30},          # plain
        {"Pclass": 1, "Sex": "female"},                       # missing key
        {"Pclass": 1, "Sex": "female", "Age": 30, "X": 5},    # extra key
        {"Pclass": 1, "Sex": None, "Age": 30},                # null value
        {"Pclass": 1, "Sex": "other", "Age": 30},             # unseen category
        {"Pclass": "1", "Sex": "female", "Age": " 30 "},      # number as text
        {"Pclass": 1, "Sex": "female", "Age": ""},            # empty text
    ], "return_probabilities": True}
    df = spark.createDataFrame([(json.dumps(payload),)], "body string")
    recs = explode_payload(df, "body", ["Pclass", "Sex", "Age"])
    assert recs.count() == 7 and recs.first()["return_probabilities"] is True
    out = {r["record_index"]: r for r in prep.transform_serving(recs, keep=["record_index"]).collect()}
    mean_age, std_age = prep.stats["Age"]
    zero_age = (0.0 - mean_age) / std_age  # missing / empty -> raw 0 before the z-score (Q1, Q10)
    assert out[0]["Age"] == out[2]["Age"] == out[3]["Age"] == out[4]["Age"] == out[5]["Age"]
    assert out[1]["Age"] == out[6]["Age"] == zero_age
    d = prep.enc_default["Sex"]
    unseen = (d - prep.stats["Sex"][0]) / prep.stats["Sex"][1]
    assert out[3]["Sex"] == out[4]["Sex"] == unseen
    assert out[5]["Pclass"] == out[0]["Pclass"]


def test_union_of_keys_in_order_of_first_appearance(spark, tmp_path):
    records = [{"b": 1, "a": "x"}, {"c.d": [1, 2]}, {"a": None, "e`f": {"g": 1}}, {}, {"B": 7}]
    path = tmp_path / "r.json"
    path.write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    got = read_records(spark, str(path))
    assert got.columns == ["b", "a", "c.d", "e`f", "B_2"]
    assert [tuple(r) for r in got.collect()][:4] == [("1", "x", None, None, None), (None, None, "[1,2]", None, None), (None, None, None, '{"g":1}', None), (None,) * 5]
    assert got.count() == 6
    df = spark.createDataFrame([(9 - k, json.dumps(r), "kept") for k, r in enumerate(records)] + [(0, None, "kept")], "k int, rec string, a string")
    wide = parse_all_records(df.repartition(3), "rec", ["k"])
    assert wide.columns == ["k", "B", "a", "e`f", "c.d", "b_2"] and wide.where("k = 9").first()["a"] == "x"
    none = parse_all_records(df.where("k = 0"), "rec", ["k"])
    assert none.columns == ["k", "a"] and none.count() == 1
