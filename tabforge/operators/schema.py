"""Projection, filter and schema alignment (B1-B9).  Name logic runs on the driver
over ``df.columns`` (no job); data work is a single narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.exprs import last_of_each_name, nan_to_null, norm_name, qcol, try_double, with_nan_as_null

PANDAS_DTYPE = {  # fixed values: pandas dtype names for Spark types
    "tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64",
    "float": "float64", "double": "float64", "boolean": "bool", "string": "object",
    "date": "object", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]",
}


def project_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """B1: exact names; an unknown name raises (like a KeyError in the reference)."""
    cols = list(features) + ([target] if target else [])
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[qcol(c) for c in cols])


def drop_null_target(df: DataFrame, target: str) -> tuple[DataFrame, int, int]:
    """B2: (rows with a target, original row count, removed count) - counts from one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(known_target(df, target)).alias("k")).first()
    return with_target(df, target), int(row["n"]), int(row["n"] - row["k"])


def known_target(df: DataFrame, target: str) -> Column:
    """The target, NaN as null."""
    return nan_to_null(qcol(target)) if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)) else qcol(target)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """The rows that have a target, without counting them."""
    return df.where(known_target(df, target).isNotNull())


def kinds_frame(df: DataFrame) -> DataFrame:
    """Per column the Spark type, the kind (numeric/categorical) and the pandas dtype name.

    A bool column is numeric only without nulls; an int column with nulls reads as float64 in pandas.
    One aggregation gives the null counts.
    """
    spark = df.sparkSession
    df = with_nan_as_null(df)
    row = df.agg(*[(F.count(F.lit(1)) - F.count(qcol(c))).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    rows = []
    for i, f in enumerate(df.schema.fields):
        nulls = int(row[f"n{i}"])
        st = f.dataType.simpleString()
        if isinstance(f.dataType, T.BooleanType):
            kind = "numeric" if nulls == 0 else "categorical"
            pdt = "bool" if nulls == 0 else "object"
        elif isinstance(f.dataType, T.NumericType):
            kind = "numeric"
            pdt = "float64" if (isinstance(f.dataType, T.IntegralType) and nulls > 0) else PANDAS_DTYPE.get(st, "float64")
        else:
            kind = "categorical"
            pdt = PANDAS_DTYPE.get(st, "object")
        rows.append((i, f.name, st, kind, pdt))
    return spark.createDataFrame(rows, "ordinal int, name string, dtype string, kind string, pandas_dtype string")


def align_mapping(columns: list[str], expected: list[str]) -> dict[str, str | None]:
    """Expected name -> actual input column, matched by lower/strip; the last duplicate wins."""
    by_key: dict[str, str] = {}
    for c in columns:
        by_key[norm_name(c)] = c
    return {e: by_key.get(norm_name(e)) for e in expected}


def align_columns(df: DataFrame, expected: list[str], numeric: list[str] | None = None) -> DataFrame:
    """B4 + B5: rename to expected names, keep expected order, drop extras; a missing expected column
    becomes raw 0.0 (numeric, or when kinds are unknown) or null (categorical)."""
    df = last_of_each_name(df)
    m = align_mapping(df.columns, expected)
    out = []
    for e in expected:
        if m[e] is not None:
            out.append(qcol(m[e]).alias(e))
        elif numeric is None or e in numeric:
            out.append(F.lit(0.0).alias(e))
        else:
            out.append(F.lit(None).cast("string").alias(e))
    return df.select(*out)


def schema_match(columns: list[str], expected: list[str], threshold: float = 0.5) -> dict:
    """Share of expected names present (name sets, lower/strip); empty expected -> 0 -> reject."""
    have = {norm_name(c) for c in columns}
    want = {norm_name(c) for c in expected}
    ratio = len(have & want) / len(want) if want else 0.0
    missing = [c for c in expected if norm_name(c) not in have]
    msg = ", ".join(missing[:5]) + ("..." if len(missing) > 5 else "")
    return {"ratio": ratio, "ok": ratio >= threshold, "missing": missing, "message": msg}


def check_schema(columns: list[str], expected: list[str], threshold: float = 0.5) -> None:
    r = schema_match(columns, expected, threshold)
    if not r["ok"]:
        raise ValueError(f"incompatible input; expected columns not found: {r['message']}")


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """B7 at load: NaN -> null in every float/double column."""
    return with_nan_as_null(df)


def attach_prediction(df: DataFrame, prediction: Column, name: str = "prediction") -> DataFrame:
    """All original columns, plus the prediction; an existing column of that name (in any case) is replaced."""
    return df.select(*[qcol(c) for c in df.columns if c.lower() != name.lower()], prediction.alias(name))


def coerce_numeric_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double when it parses after trim ('' and junk -> null); other columns unchanged."""
    cs = set(columns)
    return df.select(*[try_double(qcol(c)).alias(c) if c in cs else qcol(c) for c in df.columns])


def check_features(features: list[str], target: str, problem_type: str) -> None:
    """Argument checks before any job."""
    if problem_type not in ("classification", "regression"):
        raise ValueError("problem_type must be 'classification' or 'regression'")
    if target in features:
        raise ValueError("the target cannot be a feature")
    if not features:
        raise ValueError("no features")


__all__ = ["project_features", "drop_null_target", "kinds_frame", "align_mapping", "align_columns",
           "schema_match", "check_schema", "nan_to_null_all", "attach_prediction", "coerce_numeric_text",
           "check_features", "nan_to_null"]
