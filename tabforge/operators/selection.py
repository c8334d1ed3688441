"""Exact order statistics by digit (radix) selection on a 64-bit key.

``percentile``/``median``/``mode`` in a global aggregate merge every distinct value
of a column into one final buffer, and ``row_number`` over an un-partitioned
window moves all rows into one task.  Both grow with the data.  Here a value is
first mapped to a whole number of 64 bits in the same order (a double by its exponent and mantissa), and
the wanted ranks are followed digit by digit from the top:

1. one aggregation counts, for every wanted rank's bracket (the digits found so far), the
   rows by their next digit; partial sums first, so a bracket costs a task at most one row a digit;
2. a running sum over a bracket's digits names the digit that holds the rank;
3. the digit joins the bracket, until no digit is left and the key is known.

Ranks far apart have brackets of their own.  The number of passes follows from the key's width alone: four
digits of 16 bits where few brackets can arise, six of 12 bits where many can; ties, skew and the spread of
the values do not matter.  No sketch is involved, and only the found digits reach the driver.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import struct

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.exprs import qcol

DEFAULT_MAX_BRACKET = 1_000_000
FEW_VALUES = 100_000  # the exact median aggregate holds a count for each different value of a column
KEY_BITS, WIDE, NARROW, FEW_BRACKETS = 64, 16, 12, 16
_SMALLEST_NORMAL, _SMALLEST = 2.0 ** -1022, 2.0 ** -1074
_EPOCH = _dt.datetime(1970, 1, 1)


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))  # exact for whole exponents


def _exponent(a: Column, guess: Column) -> Column:
    return guess + F.when(a >= _power(guess + 1), 1).when(a < _power(guess), -1).otherwise(0)


def _double_size(x: Column, a: Column, e: Column) -> Column:
    # a scaled to [1, 2): both steps are exact
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / _power(e) - 1.0) * F.lit(2.0 ** 52)).cast("long")
    return (F.when(F.isnan(x), F.lit((2047 << 52) + (1 << 51))).when(a == float("inf"), F.lit(2047 << 52))
            .when(a >= _SMALLEST_NORMAL, normal).otherwise((a / F.lit(_SMALLEST)).cast("long")))


def _double_key(x: Column) -> Column:
    """A double's place among all doubles as a bigint: sign, exponent and mantissa as in its IEEE form, -0.0 like 0.0, NaN last."""
    a = F.abs(x)
    size = _double_size(x, a, _exponent(a, F.floor(F.log2(a))))
    return F.when(x < 0.0, -size).otherwise(size)


def order_keys(df: DataFrame, cols: list[str], types: dict[str, T.DataType]) -> DataFrame:
    """``order_key`` of some columns, named 0, 1, ...  A double's key comes in steps, one projection each: as one expression it
    holds the logarithm dozens of times, and Spark neither compiles that nor shares its parts."""
    names = [str(i) for i in range(len(cols))]
    doubles = [n for n, c in zip(names, cols, strict=True) if isinstance(types[c], (T.FloatType, T.DoubleType))]
    keyed = df.select(*[(qcol(c).cast("double") if n in doubles else order_key(qcol(c), types[c])).alias(n) for n, c in zip(names, cols, strict=True)])
    if not doubles:
        return keyed
    of = lambda kind, n: F.col(f"{kind}{n}")
    keyed = keyed.select("*", *[F.abs(n).alias(f"a{n}") for n in doubles])
    # infinity and NaN have no exponent
    keyed = keyed.select("*", *[F.floor(F.log2(F.when(of("a", n) < float("inf"), of("a", n)))).alias(f"g{n}") for n in doubles])
    keyed = keyed.select("*", *[_exponent(of("a", n), of("g", n)).alias(f"e{n}") for n in doubles])
    keyed = keyed.select("*", *[F.when(F.col(n).isNotNull(), _double_size(F.col(n), of("a", n), of("e", n))).alias(f"s{n}") for n in doubles])
    return keyed.select(*[(F.when(F.col(n) < 0.0, -of("s", n)).otherwise(of("s", n)) if n in doubles else F.col(n)).alias(n) for n in names])


def order_key(c: Column, dtype: T.DataType) -> Column:
    """A bigint in the order of the column's values (null stays null)."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), _double_key(c.cast("double")))
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        return (c.cast(T.DecimalType(dtype.precision, dtype.scale)) * F.lit(10 ** dtype.scale).cast(T.DecimalType(19, 0))).cast("bigint")
    raise TypeError(f"no 64-bit order key for {dtype.simpleString()}")


def key_value(key: int, dtype: T.DataType):
    """The value that ``order_key`` maps to the key."""
    if isinstance(dtype, T.IntegralType):
        return key
    if isinstance(dtype, T.BooleanType):
        return bool(key)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
        return -size if key < 0 else size
    if isinstance(dtype, T.DateType):
        return (_EPOCH + _dt.timedelta(days=key)).date()
    if isinstance(dtype, T.TimestampType):
        return _dt.datetime.fromtimestamp(key // 1_000_000).replace(microsecond=key % 1_000_000)
    if isinstance(dtype, T.TimestampNTZType):
        return _EPOCH + _dt.timedelta(microseconds=key)
    return decimal.Decimal(key).scaleb(-dtype.scale)


def _widths(brackets: int) -> list[int]:
    width = WIDE if brackets <= FEW_BRACKETS else NARROW
    return [width] * (KEY_BITS // width) + ([KEY_BITS % width] if KEY_BITS % width else [])


def kth_values(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], **earlier) -> dict[str, dict[int, object]]:
    """Values at the given 0-based ranks among non-null values of each column.

    ``counts[c]`` is the number of non-null values of ``c`` (known from an earlier pass).
    Returns ``{column: {rank: value}}``; columns with no values are omitted.  NaN sorts last.
    ``accuracy`` and ``max_bracket`` of earlier versions are accepted; nothing depends on them any more."""
    if unknown := set(earlier) - {"accuracy", "max_bracket", "max_rounds"}:
        raise TypeError(f"unexpected arguments {sorted(unknown)}")
    wanted = {c: sorted({r for r in rs if 0 <= r < counts.get(c, 0)}) for c, rs in ranks.items()}
    cols = [c for c, rs in wanted.items() if rs]
    if not cols:
        return {}
    types = {c: df.schema[c].dataType for c in cols}
    #: (column, digits so far) -> [(rank inside, rank wanted)]
    brackets = {(i, 0): [(r, r) for r in wanted[c]] for i, c in enumerate(cols)}
    left = KEY_BITS
    # the passes over many rows read the keys, which are worked out once; for few rows storing them is a job too many
    stored = max(counts[c] for c in cols) > DEFAULT_MAX_BRACKET
    keyed = order_keys(df, cols, types)
    # unsigned digits: the sign bit turned around
    keyed = keyed.select(*[F.col(k).bitwiseXOR(F.lit(-(1 << 63))).alias(k) for k in keyed.columns])
    if stored:
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for width in _widths(sum(map(len, wanted.values()))):
            brackets = _narrowed(keyed, brackets, left, width)
            left -= width
    finally:
        if stored:
            keyed.unpersist()
    out: dict[str, dict[int, object]] = {c: {} for c in cols}
    for (i, digits), found in brackets.items():
        value = key_value(digits - (1 << 63), types[cols[i]])
        out[cols[i]].update((r, value) for _, r in found)
    return out


def _narrowed(keyed: DataFrame, brackets: dict, left: int, width: int) -> dict:
    """One pass: the brackets with the next ``width`` of the ``left`` bits."""
    # unpivot and plain comparisons, which Spark compiles (an exploded array of the keys or a lambda over it is interpreted)
    long = keyed.unpivot([], keyed.columns, "col", "key").where(F.col("key").isNotNull())
    long = long.select(F.col("col").cast("int").alias("col"), "key")
    key = F.col("key")
    above = F.shiftrightunsigned(key, left) if left < KEY_BITS else F.lit(0).cast("bigint")
    if left < KEY_BITS:
        inside = F.lit(False)
        for i in range(len(keyed.columns)):
            if known := [digits for col, digits in brackets if col == i]:
                inside = inside | ((F.col("col") == i) & above.isin(known))
        long = long.where(inside)
    long = long.select("col", above.alias("above"), F.shiftrightunsigned(key, left - width).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("digit"))
    seen = long.groupBy("col", "above", "digit").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("col", "above").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("end", F.sum("n").over(w)).withColumn("first", F.col("end") - F.col("n"))
    # the wanted ranks are a few literals, so finding them costs no join
    asked = [F.struct(F.lit(i).alias("col"), F.lit(digits).cast("bigint").alias("above"), F.lit(inner).cast("bigint").alias("inner"), F.lit(rank).cast("bigint").alias("rank"))
             for (i, digits), rs in brackets.items() for inner, rank in rs]
    held = F.filter(F.array(*asked), lambda a: (a["col"] == F.col("col")) & (a["above"] == F.col("above")) & (a["inner"] >= F.col("first")) & (a["inner"] < F.col("end")))
    hit = seen.select("col", "above", "digit", "first", F.explode(held).alias("a")).select("col", "above", "digit", "first", "a.inner", "a.rank")
    out: dict = {}
    for r in hit.select("col", "above", "digit", "first", "inner", "rank").collect():  # one row a wanted rank
        out.setdefault((r["col"], r["above"] << width | r["digit"]), []).append((r["inner"] - r["first"], r["rank"]))
    return out


def median_ranks(n: int) -> list[int]:
    """0-based ranks whose mean is the median of n values (two middles when n is even)."""
    if n <= 0:
        return []
    return sorted({(n - 1) // 2, n // 2})


def exact_medians(df: DataFrame, counts: dict[str, int], max_bracket: int = DEFAULT_MAX_BRACKET, about: dict[str, int] | None = None,
                  **kw) -> dict[str, float]:
    """Median with two-middle interpolation (pandas / DuckDB ``median``), all columns at once.

    The exact ``median`` aggregate is used directly where its per-column buffer, a count for each different value, is
    small: every column has at most ``max_bracket`` values, or a column at most ``FEW_VALUES`` different ones by ``about``, an
    estimate from an earlier pass, however many rows; the other columns go through the digit selection."""
    live = {c: n for c, n in counts.items() if n > 0}
    few = list(live)
    if live and max(live.values()) > max_bracket:
        few = [c for c in live if c in (about or {}) and about[c] <= min(FEW_VALUES, max_bracket)]
    out = {}
    if few:
        row = df.agg(*[F.median(qcol(c)).alias(str(i)) for i, c in enumerate(few)]).first()
        out = {c: float(row[str(i)]) for i, c in enumerate(few)}
    ks = {c: median_ranks(n) for c, n in live.items() if c not in out}
    if not ks:
        return out
    vals = kth_values(df, ks, counts, **kw)
    for c, rs in ks.items():
        got = vals.get(c, {})
        xs = [float(got[r]) for r in rs]
        out[c] = xs[0] if len(xs) == 1 else xs[0] + (xs[1] - xs[0]) * 0.5
    return out


def ceil_fraction(n: int, fraction: float) -> int:
    return int(math.ceil(fraction * n - 1e-9))
