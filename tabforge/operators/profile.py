"""Column profile (C1-C8): row/column counts, distinct and null counts, null share,
first non-null values in key or file order, dtype labels and the numeric/categorical tally.

Columns are unpivoted to ``(column, value)`` once per type family (integral,
floating, text) so values are grouped in their own type.  Distinct and
null counts use a two-level aggregation: ``groupBy(column, value)`` (partial
aggregation map-side, so a value holding a third of the rows is combined before
the shuffle), then ``groupBy(column)`` over the distinct pairs.  There is no
``countDistinct`` per column in one ``agg`` (that expands every row N times).
Samples (first ``k`` non-null values per column in key order) come from
TakeOrderedAndProject heaps, not from sorting the table: the first rows by key
for all columns at once, and one more job for all columns with many nulls together
(their few non-null values ranked by key, with Spark's partial group limit before the shuffle).
NaN counts as missing throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.exprs import py_float_text, qcol, with_nan_as_null

SAMPLE_SIZE = 5


def _as_text(df: DataFrame, c: str):
    """Sample text of a value: doubles laid out like Python's ``str`` (1e7 -> '10000000.0')."""
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, T.DoubleType):
        return py_float_text(qcol(c))
    return qcol(c).cast("string")


def shape(df: DataFrame) -> DataFrame:
    """num_rows, num_columns."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select("num_rows", F.lit(len(df.columns)).alias("num_columns"))


def _families(df: DataFrame) -> dict[str, list[str]]:
    """Columns by the type their values are grouped as: integral/bool as bigint, float as double,
    everything else as text (so -0.0 and 0.0 are one value, as in pandas ``nunique``)."""
    from pyspark.sql import types as T

    fam: dict[str, list[str]] = {"bigint": [], "double": [], "string": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            fam["bigint"].append(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            fam["double"].append(f.name)
        else:
            fam["string"].append(f.name)
    return {k: v for k, v in fam.items() if v}


BITS = 32768  # fixed value: values to a bucket of Spark's bitmap functions
BITMAP_BYTES, PAIR_BYTES = 4096, 24  # of a shuffled bitmap; of a shuffled (column, value, count) row


def bitmap_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Integral columns whose distinct values shuffle in fewer bytes as bitmaps than as one row a value.

    Both forms are bounded from one narrow pass that keeps least, greatest and number of values of each input partition: a
    partition sends at most one bitmap for each bucket that its range touches, and at most one pair for each value of its range,
    never more of either than it has values.  Keys that lie together (ordered ids, dense ranges) win by far; random 64-bit keys stay pairs."""
    if not cols:
        return []
    part = df.groupBy(F.spark_partition_id().alias("__part")).agg(*[
        e for i, c in enumerate(cols) for e in (F.min(qcol(c).cast("bigint")).alias(f"lo{i}"), F.max(qcol(c).cast("bigint")).alias(f"hi{i}"),
                                                F.count(qcol(c)).alias(f"n{i}"))])
    def span(i: int):  # of doubles: the span of 64-bit values does not fit 64 bits
        return F.col(f"hi{i}").cast("double") - F.col(f"lo{i}").cast("double")
    got = part.agg(*[e for i in range(len(cols)) for e in (
        F.sum(F.least(span(i) / BITS + 2, F.col(f"n{i}").cast("double")) * BITMAP_BYTES).alias(f"b{i}"),
        F.sum(F.least(span(i) + 1, F.col(f"n{i}").cast("double")) * PAIR_BYTES).alias(f"p{i}"))]).first()
    return [c for i, c in enumerate(cols) if got[f"b{i}"] is not None and got[f"b{i}"] < got[f"p{i}"]]


def _bitmap_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, nn, unique_count): a bitmap for each bucket of 32,768 values, united by bucket, then bits are counted."""
    long = df.select(*[qcol(c).cast("bigint").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    made = long.groupBy("column", F.bitmap_bucket_number("value").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("nn"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("value"))).alias("bits"))
    return made.groupBy("column").agg(F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("bits").alias("unique_count"))


def counts(df: DataFrame, approx: bool = False, key: list[str] | None = None) -> DataFrame:
    """Per column unique_count (nulls excluded), null_count, null_percentage.

    One unpivot per type family (each reads only its own columns); values are grouped in their
    own type, which is cheaper than grouping text.  Integral columns whose values lie close together are
    counted through bitmaps instead (``bitmap_columns``): what they shuffle is bounded by their range, an eighth of a byte a value."""
    df = with_nan_as_null(df)
    fam = _families(df)
    dense = [] if approx else bitmap_columns(df, fam.get("bigint", []))
    per = _bitmap_counts(df, dense) if dense else None
    for typ, cols in fam.items():
        cols = [c for c in cols if c not in dense]
        if not cols:
            continue
        long = df.select(*[qcol(c).cast(typ).alias(c) for c in cols]).unpivot([], cols, "column", "value")
        if approx:
            part = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("nn"),
                                              F.approx_count_distinct("value").alias("unique_count"))
        else:
            pairs = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
            part = pairs.groupBy("column").agg(
                F.sum("cnt").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")).otherwise(0)).alias("nn"),
                F.count("value").alias("unique_count"))
        per = part if per is None else per.unionByName(part)
    null_count = (F.col("n") - F.col("nn")).cast("bigint")
    pct = F.when(F.col("n") > 0, null_count / F.col("n") * 100.0).otherwise(F.lit(0.0))
    return per.select("column", F.col("unique_count").cast("bigint").alias("unique_count"),
                      null_count.alias("null_count"), pct.alias("null_percentage"))


def file_order(df: DataFrame):
    """A key that orders rows as their files hold them: file path, start of the split in the file, place in the split.  Rows
    that don't come straight from files (after a shuffle, or made in memory) are ordered by partition and place in it."""
    from pyspark.errors import AnalysisException
    place = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path").schema  # analysed only
    except AnalysisException:
        return F.struct(place.alias("place"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("place"))


def sample_rows(df: DataFrame, key: list[str] | None = None, k: int = SAMPLE_SIZE, head_rows: int = 64
                ) -> dict[str, list[str]]:
    """First k non-null values per column in key order, without sorting the table; without a key in the order
    of the files (``file_order``).

    The first ``head_rows`` rows by key come from one TakeOrderedAndProject (a bounded heap per
    partition); the columns still short of k values (many nulls) share one ranked job over their
    non-null values, cut to k per column before the shuffle.  At most
    ``head_rows + k * columns`` rows reach the driver."""
    cols = df.columns
    kcol = F.struct(*[qcol(c) for c in key]) if key else file_order(df)
    # the place is taken where the rows are read, before anything else
    keyed = df.select(kcol.alias("__key"), "*") if "__key" not in cols else df
    keyed = with_nan_as_null(keyed)
    # top-k on the raw rows first; only the selected rows are rendered as text
    head = (keyed.orderBy("__key").limit(head_rows)
            .select(*[_as_text(df, c).alias(c) for c in cols]).collect())
    out = {c: [r[c] for r in head if r[c] is not None][:k] for c in cols}
    short = [c for c in cols if len(out[c]) < k and len(head) == head_rows]
    if short:  # one job whatever their number; at most k rows a column come back
        long = keyed.select("__key", *[_as_text(df, c).alias(c) for c in short]).unpivot("__key", short, "column", "value")
        w = Window.partitionBy("column").orderBy("__key")
        ranked = long.where("value IS NOT NULL").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        found = ranked.select("column", "rn", "value").collect()
        for c in short:
            out[c] = [r["value"] for r in sorted((r for r in found if r["column"] == c), key=lambda r: r["rn"])]
    return out


def samples(df: DataFrame, key: list[str] | None = None, k: int = SAMPLE_SIZE) -> DataFrame:
    """(column, sample_values array<string>) in key order."""
    got = sample_rows(df, key, k)
    return df.sparkSession.createDataFrame([(c, v) for c, v in got.items()],
                                           "column string, sample_values array<string>")


def profile_table(df: DataFrame, key: list[str] | None = None, approx: bool = False,
                  k: int = SAMPLE_SIZE) -> DataFrame:
    """One row per column in column order with the fields of the reference profile.

    Two jobs over the data: the grouped counts (which also give the null counts the dtype and
    kind labels need) and the sample heap.  The result has one row per column."""
    cnt = {r["column"]: r for r in counts(df, approx=approx).collect()}  # one row per column
    smp = sample_rows(df, key, k)
    rows = []
    for i, f in enumerate(df.schema.fields):
        r = cnt[f.name]
        kind, pdt = _kind(f.dataType, r["null_count"])
        rows.append((i, f.name, pdt, kind, r["unique_count"], r["null_count"], r["null_percentage"], smp[f.name]))
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, dtype string, kind string, unique_count bigint, null_count bigint, "
              "null_percentage double, sample_values array<string>")


def _kind(dt, nulls: int) -> tuple[str, str]:
    from pyspark.sql import types as T

    from tabforge.operators.schema import PANDAS_DTYPE
    st = dt.simpleString()
    if isinstance(dt, T.BooleanType):
        return ("numeric", "bool") if nulls == 0 else ("categorical", "object")
    if isinstance(dt, T.NumericType):
        return "numeric", ("float64" if isinstance(dt, T.IntegralType) and nulls > 0 else PANDAS_DTYPE.get(st, "float64"))
    return "categorical", PANDAS_DTYPE.get(st, "object")


def tally(profile: DataFrame) -> DataFrame:
    """numeric/categorical counts by dtype name (int/float in the name) and null flags."""
    is_num = F.col("dtype").contains("int") | F.col("dtype").contains("float")
    flag = (F.when(F.col("null_percentage") > 20, "high").when(F.col("null_percentage") > 0, "some")
            .otherwise("none"))
    return profile.agg(
        F.sum(F.when(is_num, 1).otherwise(0)).cast("bigint").alias("numeric_columns"),
        F.sum(F.when(is_num, 0).otherwise(1)).cast("bigint").alias("categorical_columns"),
        F.sum(F.when(flag == "high", 1).otherwise(0)).cast("bigint").alias("high_null_columns"),
        F.sum(F.when(flag == "some", 1).otherwise(0)).cast("bigint").alias("some_null_columns"),
    )


def leak_warnings(profile: DataFrame, num_rows: int, threshold: float = 0.5) -> DataFrame:
    """Q5: categorical columns whose distinct share exceeds ``threshold`` (target encoding would leak)."""
    return profile.where((F.col("kind") == "categorical") & (F.col("unique_count") > F.lit(threshold * num_rows))) \
        .select("name", "unique_count")
