"""First values in file order (several files, several splits) and distinct counts through bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import profile as prof


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_first_values_in_file_order(spark, tmp_path, fmt):
    """Files of unlike sizes, the largest in the middle: the reader packs them by size, so partition order is not file order."""
    rnd = random.Random(3)
    rows, n = [], 0
    for i, size in enumerate((3, 40_000, 500)):
        part = [(n + j, None if n + j < 2 or rnd.random() < 0.3 else f"v{n + j}", f"r{n + j}" if i == 2 and j % 100 == 7 else None) for j in range(size)]
        n += size
        rows += part
        spark.createDataFrame(part, "id bigint, often string, rare string").coalesce(1).write.format(fmt).save(str(tmp_path / f"d/p={i}"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = spark.read.schema("id bigint, often string, rare string").format(fmt).load(str(tmp_path / "d")).drop("p")
        assert df.rdd.getNumPartitions() > 2
        got = prof.sample_rows(df)
        again = prof.sample_rows(df.where("id >= 0").select("rare", "often"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for c, at in (("often", 1), ("rare", 2)):
        want = [r[at] for r in rows if r[at] is not None][:5]
        assert got[c] == want and again[c] == want
    assert got["id"] == ["0", "1", "2", "3", "4"]


def test_rows_not_from_files(spark):
    assert prof.sample_rows(spark.createDataFrame([(None, float("nan")), ("a", 1.0)], "t string, v double")) == {"t": ["a"], "v": ["1.0"]}


def test_bitmap_counts_equal_grouping(spark):
    big = 2 ** 63 - 1
    values = [0, 1, -1, 32768, 32767, -32768, -32769, 65536, big, -big - 1, big - 1, None, None, 5, 5]
    df = spark.createDataFrame([(v, None) for v in values], "v bigint, w int")
    got = {r["column"]: r for r in prof._bitmap_counts(df, ["v", "w"]).collect()}
    assert got["v"]["unique_count"] == len(set(values) - {None}) and got["v"]["nn"] == 13 and got["v"]["n"] == 15
    assert got["w"]["unique_count"] == 0 and got["w"]["nn"] == 0


def test_dense_columns_take_bitmaps(spark):
    df = spark.range(0, 200_000, numPartitions=4).select(
        "id", (F.col("id") % 7).alias("few"), F.xxhash64("id").alias("wide"), F.when(F.col("id") % 3 == 0, F.col("id") - 100_000).cast("int").alias("third"),
        (F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("bigint").alias("none"))
    assert prof.bitmap_columns(df, df.columns) == ["id", "third"]
    got = {r["column"]: (r["unique_count"], r["null_count"]) for r in prof.counts(df).collect()}
    assert got == {"id": (200_000, 0), "few": (7, 0), "wide": (200_000, 0), "third": (66_667, 133_333), "flag": (2, 0), "none": (0, 200_000)}
    empty = df.where("id < 0")
    assert {(r["unique_count"], r["null_percentage"]) for r in prof.counts(empty).collect()} <= {(0, 0.0)}
