import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.operators import profile as prof
from tabforge.operators import schema as S
from tabforge.sources import csv as C
from tabforge.plans import fixtures as fx
from conftest import SF01


def test_profile_matches_pandas(spark):
    df = fx.orders_ml(spark, SF01).select("o_orderkey", "x", "c", "hc", "ynull")
    pdf = df.toPandas().sort_values("o_orderkey")
    t = {r["name"]: r for r in prof.profile_table(df, key=["o_orderkey"]).collect()}
    for c in pdf.columns:
        assert t[c]["unique_count"] == pdf[c].nunique()
        assert t[c]["null_count"] == pdf[c].isnull().sum()
        assert t[c]["null_percentage"] == pytest.approx(pdf[c].isnull().mean() * 100)
    assert t["c"]["sample_values"] == pdf["c"].dropna().head(5).tolist()
    assert t["x"]["dtype"] == "float64" and t["c"]["dtype"] == "object" and t["o_orderkey"]["dtype"] == "int64"
    assert prof.shape(df).first().asDict() == {"num_rows": len(pdf), "num_columns": 5}


def test_align_and_gate():
    m = S.align_mapping(["Age", " age ", "Fare"], ["age", "fare", "sex"])
    assert m == {"age": " age ", "fare": "Fare", "sex": None}  # last duplicate wins
    r = S.schema_match(["A", "b"], ["a", "B", "c", "d", "e", "f", "g"])
    assert r["ratio"] == pytest.approx(2 / 7) and not r["ok"] and r["message"] == "c, d, e, f, g"
    r = S.schema_match(["a"], ["a", "b", "c", "d", "e", "f", "g", "h"])
    assert r["message"].endswith("...")
    assert S.schema_match(["a"], [])["ratio"] == 0.0
    with pytest.raises(ValueError):
        S.check_schema(["x"], ["a", "b"])


def test_coerce_and_nan(spark):
    df = spark.createDataFrame([(" 30 ",), ("",), ("x",), (None,)], "v string")
    assert [r["v"] for r in S.coerce_numeric_text(df, ["v"]).collect()] == [30.0, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r["v"] for r in S.nan_to_null_all(nan).collect()] == [None, 1.0]


def test_csv_reader_rules(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,price,name,flag,note\n1,2.5,"Smith, J",True,NA\n2,,"multi\nline",False,n/a\n3,4,x,True,ok\n')
    df = C.read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "price": "double", "name": "string", "flag": "boolean", "note": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == "Smith, J" and rows[1]["name"] == "multi\nline"
    assert rows[1]["price"] is None and rows[0]["note"] is None and rows[1]["note"] is None
    pd_df = pd.read_csv(str(p))
    assert pd_df["price"].isnull().sum() == df.where(F.col("price").isNull()).count()


@pytest.mark.parametrize("body, spans", [
    ('a,b\n1,"x, y"\n2,"say ""hi"""\n3,""\n', False), ('a,b\r\n1,"x"\r\n', False), ('a,b\n', False), ('a,b\n1,plain\n', False),
    ('a,b\n1,"two\nlines"\n', True), ('a,b\n1,"ends ""quoted""\nhere"\n', True), ('a,b\nx"y,"two\nlines"\n', True), ('a,b\n1,"a"",\nb"\n', True)])
def test_csv_lines_with_open_quotes(spark, tmp_path, body, spans):
    p = tmp_path / "in.csv"
    p.write_bytes(body.encode())
    assert C.has_open_quotes(spark, str(p)) == spans
    got = [tuple(r) for r in C.read_csv_text(spark, str(p)).collect()]
    assert got == [tuple(r) for r in C.read_csv_text(spark, str(p), multi_line=True).collect()]


def test_csv_without_newlines_in_fields_is_split(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a|b\n" + "".join(f'{k}|"text | {k}"\n' for k in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = C.read_csv(spark, str(p), sep="|")
        assert df.rdd.getNumPartitions() > 1 and df.count() == 2000
        assert df.agg(F.sum("a")).first()[0] == 1999000 and df.where("b = concat('text | ', a)").count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
