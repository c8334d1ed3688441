"""Reproducible held-out split by key hash (D1) and its exact-size variant.

The split is decided per row from ``md5(seed|key1|key2|...)``: stateless, the
same on every partitioning and every re-run, and reproducible in SQL.  Rows
identical in all key columns land on the same side.  ``randomSplit`` is not used:
its membership depends on partitioning and row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.exprs import hash_hex, hex_threshold, qcol
from tabforge.operators.selection import ceil_fraction, kth_values

DEFAULT_SEED = 42
DEFAULT_TEST_FRACTION = 0.2


def default_keys(df: DataFrame) -> list[str]:
    return list(df.columns)


def holdout_flag(df: DataFrame, keys: list[str] | None = None, seed: int = DEFAULT_SEED,
              test_fraction: float = DEFAULT_TEST_FRACTION) -> Column:
    keys = keys or default_keys(df)
    thr = hex_threshold(test_fraction)
    return F.substring(hash_hex(seed, keys), 1, len(thr)) < F.lit(thr)


def with_split(df: DataFrame, keys: list[str] | None = None, seed: int = DEFAULT_SEED,
               test_fraction: float = DEFAULT_TEST_FRACTION, col: str = "is_test") -> DataFrame:
    """Adds a boolean held-out flag; a narrow projection, no shuffle."""
    return df.withColumn(col, holdout_flag(df, keys, seed, test_fraction))


def split_hash(df: DataFrame, keys: list[str] | None = None, seed: int = DEFAULT_SEED,
               test_fraction: float = DEFAULT_TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash; about ``test_fraction`` of the rows are held out."""
    flag = holdout_flag(df, keys, seed, test_fraction)
    return df.where(~flag), df.where(flag)


def _hash60(h: Column) -> Column:
    # first 15 hex digits as an exact bigint in [0, 2^60): orderable and sketchable
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def exact_holdout_flag(df: DataFrame, keys: list[str], seed: int = DEFAULT_SEED,
                    test_fraction: float = DEFAULT_TEST_FRACTION, n: int | None = None,
                    **kw) -> Column:
    """Flag of the ``ceil(test_fraction * n)`` rows first in ``(md5, keys)`` order.

    Found with the bracketed k-th selection, not a global window sort; exact when the
    keys are unique (rows identical in every key column stay together).
    """
    h = hash_hex(seed, keys)
    if n is None:
        n = df.count()
    k = ceil_fraction(n, test_fraction)
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    tmp = df.select(_hash60(h).alias("__h60"), h.alias("__md5"), *[qcol(c) for c in keys])
    v = kth_values(tmp, {"__h60": [k - 1]}, {"__h60": n}, **kw)["__h60"][k - 1]
    v = int(v)
    below = tmp.where(F.col("__h60") < F.lit(v)).count()
    need = k - below  # rows to take from the group sharing the threshold prefix
    # distinct (md5, keys) tuples of that group with their row counts: identical keys stay together,
    # so this is one row per distinct key tuple (a 60-bit prefix collision of distinct keys is rare)
    tie = (tmp.where(F.col("__h60") == F.lit(v)).groupBy("__md5", *keys).agg(F.count(F.lit(1)).alias("__n"))
           .orderBy("__md5", *keys).collect())
    last, taken = tie[0], 0
    for row in tie:
        if taken >= need:
            break
        last, taken = row, taken + row["__n"]
    last = [last["__md5"]] + [last[c] for c in keys]
    thr = F.struct(F.lit(last[0]).alias("__md5"), *[F.lit(last[i + 1]).alias(c) for i, c in enumerate(keys)])
    cur = F.struct(h.alias("__md5"), *[qcol(c).alias(c) for c in keys])
    hc = _hash60(h)
    return (hc < F.lit(v)) | ((hc == F.lit(v)) & (cur <= thr))


def split_exact(df: DataFrame, keys: list[str], seed: int = DEFAULT_SEED,
                test_fraction: float = DEFAULT_TEST_FRACTION, **kw) -> tuple[DataFrame, DataFrame]:
    flag = exact_holdout_flag(df, keys, seed, test_fraction, **kw)
    return df.where(~flag), df.where(flag)
