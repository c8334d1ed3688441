"""CSV source with the reader rules of the reference (A1) and a CSV sink (A5).

The file is read as text (header row, quoted fields with embedded commas and
newlines), pandas' missing-value strings become null, and column types are
inferred in ONE distributed aggregation: a column is ``bigint`` when every
non-null cell parses as an integer, ``double`` when every cell parses as a
number, ``boolean`` for True/False text, else ``string``.  NaN in the result
is null (B7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.exprs import INTEGER, na_string_to_null, qcol, try_double
from tabforge.sources.csv_ranges import has_open_quotes, read_records

BOOL_TEXT = ("True", "False", "TRUE", "FALSE", "true", "false")  # fixed values: pandas bool literals


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """Quoted fields may hold newlines, as for the reference's reader.  ``multi_line=None`` finds out by a pass over the lines
    whether any does and reads such files in byte ranges too (``csv_ranges``); False saves that pass where none does, True
    is Spark's own reader with one task a file."""
    if multi_line is None and has_open_quotes(spark, path, sep):
        return read_records(spark, path, sep)
    return (spark.read.option("header", True).option("inferSchema", False).option("multiLine", bool(multi_line))
            .option("escape", '"').option("sep", sep).option("nullValue", None)
            .option("emptyValue", "").csv(path))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns -> inferred types, one aggregation over the data."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = na_string_to_null(qcol(c))
        t = F.trim(v)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.when(t.rlike(INTEGER), t.try_cast("bigint"))).alias(f"i{i}"),
                 F.count(try_double(t)).alias(f"d{i}"),
                 F.count(F.when(t.isin(*BOOL_TEXT), 1)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        v = na_string_to_null(qcol(c))
        n = r[f"n{i}"]
        if n == 0:
            out.append(v.cast("double").alias(c))  # all-missing column reads as float in pandas
        elif r[f"i{i}"] == n:
            out.append(F.trim(v).cast("bigint").alias(c))
        elif r[f"d{i}"] == n:
            out.append(try_double(v).alias(c))
        elif r[f"b{i}"] == n:
            out.append(F.lower(F.trim(v)).cast("boolean").alias(c))
        else:
            out.append(v.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    return infer_types(read_csv_text(spark, path, sep, multi_line))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Header, no index; one folder per run (a run id in the path, never overwritten by default)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path
