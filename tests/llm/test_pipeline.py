"""The numbered queries' oracles and the pipeline's stages on a small driver table."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from tabforge.llm import simhash
from tabforge.llm.queries import ORACLES, QUERIES

SF001 = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    df = QUERIES[name](spark, SF001)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in res.fetchall())


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, SF001).write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        if k < 4:
            assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        had = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert set(ids) <= had
        if k == 1:
            assert len(ids) == before.count()
        if k == 2:
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert sorted(ids) == sorted(want)
        if k == 3:
            assert set(ids) == had
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
