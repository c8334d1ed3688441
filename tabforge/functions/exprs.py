"""Column-expression helpers.  All are built-in Spark expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings pandas 2.x reads as missing in a CSV cell (read_csv default na_values).
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: hex prefix below which a row falls on the held-out side (0x33333333 / 2^32 = 0.2).
TEST_HEX_THRESHOLD_20PCT = "33333333"


def qcol(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and back-ticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm_name(name: str) -> str:
    """Name key used for matching input columns to expected features."""
    return name.lower().strip()


def nan_to_null(c: Column) -> Column:
    """NaN becomes null (pandas treats both as missing; Spark aggregates do not)."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def na_string_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


# The spellings of numbers that pandas reads (a cast alone would also take 12F, 12D and 0x1p3).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def try_double(c: Column) -> Column:
    """Text to double when it is a decimal number or an infinity (after trim), else null, as is NaN; never raises under ANSI."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER) | t.rlike(INFINITE), t.try_cast(T.DoubleType()))


def number(c: Column, dtype: T.DataType | None, fitted_bool: bool = False) -> Column:
    """A column as double, NaN as null: numbers and booleans are cast, text is parsed; for a feature that was boolean
    at fit the texts true and false (in any case) are 1 and 0."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return nan_to_null(c.cast("double"))
    if not fitted_bool:
        return try_double(c)
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(try_double(c))


def last_of_each_name(df: DataFrame) -> DataFrame:
    """Of columns whose names differ only in case the last one: Spark resolves names without case, so they can't
    stand side by side.  Selected by position, so duplicates are no ambiguity."""
    last = {c.lower(): i for i, c in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    by_place = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns) if last[c.lower()] == i])


def hash_hex(seed: int, keys: list[str]) -> Column:
    """md5 hex of ``seed|k1|k2|...`` (keys rendered as text, nulls left out)."""
    parts = [F.lit(str(seed))] + [qcol(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hex_threshold(test_fraction: float, width: int = 8) -> str:
    """Hex prefix whose value / 16^width equals ``test_fraction`` (rounded down)."""
    v = int(test_fraction * (16 ** width))
    v = max(0, min(v, 16 ** width - 1))
    return format(v, f"0{width}x")


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def with_nan_as_null(df: DataFrame) -> DataFrame:
    """One projection that turns NaN into null in every float/double column (op B7)."""
    fc = set(float_columns(df))
    if not fc:
        return df
    return df.select(*[nan_to_null(qcol(c)).alias(c) if c in fc else qcol(c) for c in df.columns])


def py_float_text(c: Column) -> Column:
    """Double as text laid out like Python's ``str(float)`` (profile samples), from Spark's
    shortest round-trip digits: plain notation for exponents -4..15, else ``d.ddde+XX``."""
    s = c.cast("double").cast("string")  # e.g. 123.45, 1.23456789E7, 1.0E-4, Infinity
    sci = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign = F.regexp_extract(s, sci, 1)
    lead = F.regexp_extract(s, sci, 2)
    frac = F.regexp_replace(F.regexp_extract(s, sci, 3), "0+$", "")
    digits = F.concat(lead, frac)
    e = F.regexp_extract(s, sci, 4).cast("int")
    zeros = F.repeat(F.lit("0"), F.greatest(e + 1 - F.length(digits), F.lit(0)))
    int_part = F.concat(digits.substr(F.lit(1), e + 1), zeros)
    rest = digits.substr(e + 2, F.lit(64))
    big = F.concat(sign, int_part, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))  # 7 <= e <= 15
    small = F.concat(sign, F.lit("0.000"), digits)  # e == -4
    mant = F.concat(lead, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    expo = F.concat(F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
    scientific = F.concat(sign, mant, F.lit("e"), expo)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s == "Infinity", F.lit("inf")).when(s == "-Infinity", F.lit("-inf"))
            .when(~s.rlike(sci), s)
            .when((e >= 7) & (e <= 15), big)
            .when(e == -4, small)
            .otherwise(scientific))
