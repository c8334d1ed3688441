"""CSV in byte ranges against Spark's one-task reader."""

import csv
import glob
import random

import pytest

from tabforge.sources.csv import read_csv, read_csv_text
from tabforge.sources import csv_ranges


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, n, sep=",", ending="\n", seed=1, long=0):
    rng = random.Random(seed)
    pick = ["plain", "", "a b", 'say "hi"', "two\nlines", f"with{sep} sep", f'"\n{sep}"', "x\n\n\ny", f'end"{sep}\n', '""', "é", '"', "'", f'\n{sep}"{sep}\n', "5"]
    with open(path, "w", newline="") as f:
        w = csv.writer(f, delimiter=sep, lineterminator=ending)
        w.writerow(["id", "te xt", "a\nb", "last"])
        for k in range(n):
            w.writerow([k, rng.choice(pick), "".join(rng.choice(pick) for _ in range(3)) if k != n // 2 else "line\n" * long, rng.choice(pick)])


def same(spark, path, sep=",", ending="\n"):
    got, want = csv_ranges.read_records(spark, path, sep), read_csv_text(spark, path, sep, multi_line=True)
    assert got.columns == want.columns
    rows = sorted(map(repr, map(tuple, got.collect())))
    if ending == "\n":  # of mixed endings Spark's reader takes one kind and leaves the others' carriage returns in the values
        assert rows == sorted(map(repr, map(tuple, want.collect())))
    plain = []
    for name in sorted(glob.glob(f"{path}/*.csv")) or [path]:
        with open(name, newline="") as f:
            plain += list(csv.reader(f, delimiter=sep))[1:]
    assert sorted(repr(tuple(v or "" for v in r)) for r in got.collect()) == sorted(map(repr, map(tuple, plain)))
    return len(rows)


@pytest.mark.parametrize("sep, ending, size", [(",", "\n", 97), (";", "\r\n", 150), ("|", "\n", 1000), ("\t", "\n", 64)])
def test_equal_to_one_task(spark, tmp_path, small_ranges, sep, ending, size):
    for k in range(2):
        write(tmp_path / f"{k}.csv", 120, sep, ending, seed=k)
    small_ranges(size)
    assert csv_ranges.lines(spark, str(tmp_path), sep).rdd.getNumPartitions() > 5
    assert same(spark, str(tmp_path), sep, ending) == 240


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", 9, long=400)
    small_ranges(128)
    assert same(spark, str(tmp_path / "a.csv")) == 9


def test_all_tasks_read(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", 5000)
    small_ranges(32_000)
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert df.rdd.getNumPartitions() >= 5 and dict(df.dtypes)["id"] == "bigint"
    assert df.agg({"id": "sum", "te xt": "count"}).first()[0] == sum(range(5000)) or df.count() == 5000
    assert sorted(r["id"] for r in df.select("id").collect()) == list(range(5000))


def test_states_of_lines(spark):
    cases = [('a,b', False, True), ('a,"b', True, False), ('a,"b"', False, False), ('"', True, False), ('""', False, True), ('"""', True, False),
             ('5" x,b', False, False), ('x"', False, False), ('x","y', True, True), ('x",y', False, False), ('",""', True, False), ('a,"",b', False, True), ('', False, True)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    got = df.select("v", csv_ranges.opens(df.v, ",").alias("o"), csv_ranges.stays(df.v, ",").alias("s")).collect()
    # a quote inside an unquoted field opens nothing, but closes an open one
    assert [tuple(r) for r in got] == cases


def test_header_only_and_blank_lines(spark, tmp_path):
    (tmp_path / "h.csv").write_text('a,"b\nc"\n')
    assert csv_ranges.read_records(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "b.csv").write_text('a,b\n\n1,"x\ny"\n\n2,z\n')
    assert sorted(map(tuple, csv_ranges.read_records(spark, str(tmp_path / "b.csv")).collect())) == [("1", "x\ny"), ("2", "z")]
