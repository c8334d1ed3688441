"""Leak-free preparation: fit on training rows, apply to held-out and new rows.

Fit order is kinds -> impute (median / mode) -> encode categoricals (target mean,
or row share when the target is not numeric) -> z-score.  The fit runs as a few
bounded aggregations over the training rows:

* pass A: row count, target sum, and per numeric column count / mean / M2
  (Spark's stable central-moment aggregate) and per categorical column nulls;
* pass B: exact medians by bracketed selection (``selection.py``), or
  ``percentile_approx`` with ``median="approx"``;
* pass C: one unpivot + ``groupBy(column, category)`` with count and target sum
  (partial aggregation first, so a category holding a third of the rows is
  combined map-side).  Modes, encodings, their mean/std and the unseen default
  all derive from this small table; no second pass over the rows.

Mean/std after filling nulls with the median come from pass A by merging the
non-null moments with ``n_null`` copies of the median (Chan et al. update).

Transforms are one projection: literals for medians and statistics, a map
literal for encodings whose size is proven small at fit, and for larger ones a
broadcast join (size checked) or a salted shuffle join with hot categories
spread over ``salt_buckets`` tasks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.exprs import last_of_each_name, nan_to_null, norm_name, number, qcol, with_nan_as_null
from tabforge.operators.selection import exact_medians
from tabforge.session import cut_lineage

UNKNOWN_CATEGORY = "UNKNOWN"  # fixed value: mode of a column with no values
DEFAULT_MAP_MAX = 200  # encodings up to this many categories become a map literal (a lookup scans it)
DEFAULT_MAP_TOTAL_MAX = 4_000  # ...while all map literals together stay under this many entries
DEFAULT_BROADCAST_BYTES = 32 << 20  # estimated bytes; larger encoding tables are joined by shuffle
DEFAULT_BROADCAST_TOTAL_BYTES = 256 << 20  # all broadcast encoding tables of one transform together
DEFAULT_HOT_SHARE = 0.01  # a category with this share of training rows is salted
DEFAULT_SALT_BUCKETS = 32


def numeric_kind(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def column_kinds(df: DataFrame, features: list[str], null_counts: dict[str, int] | None = None
                 ) -> tuple[list[str], list[str]]:
    """(numeric, categorical): numbers and bools without nulls are numeric."""
    num, cat = [], []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in features:
        dt = types[c]
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"nested column {c!r} cannot be a feature")
        if numeric_kind(dt):
            num.append(c)
        elif isinstance(dt, T.BooleanType):
            if null_counts is None:
                raise ValueError("bool columns need null counts to be classified")
            (num if null_counts.get(c, 0) == 0 else cat).append(c)
        else:
            cat.append(c)
    return num, cat


def _merge_fill_moments(n_total: int, n_nn: int, mean_nn, m2_nn, fill: float) -> tuple[float, float]:
    """Mean and sample std of a column whose nulls are replaced by ``fill``."""
    if n_total == 0:
        return float("nan"), float("nan")
    n_null = n_total - n_nn
    if n_nn == 0:
        mean, m2 = fill, 0.0
    else:
        mean_nn = float(mean_nn)
        m2_nn = float(m2_nn or 0.0)
        mean = (n_nn * mean_nn + n_null * fill) / n_total
        d = fill - mean_nn
        m2 = m2_nn + d * d * n_nn * n_null / n_total
    std = math.sqrt(m2 / (n_total - 1)) if n_total > 1 else float("nan")
    return mean, std


@dataclass
class FittedPrep:
    features: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]
    imputation: dict = field(default_factory=dict)  # numeric -> median (0.0 when none), categorical -> mode
    stats: dict = field(default_factory=dict)  # column -> [mean, std]; std stored 1.0 when not > 0
    fit_zero: list = field(default_factory=list)  # columns set to 0 on the training rows (std not > 0)
    enc_default: dict = field(default_factory=dict)  # unweighted mean of the encodings (unseen category)
    n_categories: dict = field(default_factory=dict)
    category_bytes: dict = field(default_factory=dict)
    hot_categories: dict = field(default_factory=dict)
    small_encodings: dict = field(default_factory=dict)  # column -> {category: enc}, proven small
    target_numeric: bool = True
    target_mean: float = 0.0
    report: dict = field(default_factory=dict)
    input_schema: str = ""
    map_max: int = DEFAULT_MAP_MAX
    map_total_max: int = DEFAULT_MAP_TOTAL_MAX
    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES
    broadcast_total_bytes: int = DEFAULT_BROADCAST_TOTAL_BYTES
    salt_buckets: int = DEFAULT_SALT_BUCKETS
    encodings: DataFrame | None = None  # (column, category, n, enc) for every categorical column

    # ------------------------------------------------------------------ fit
    @classmethod
    def fit(cls, df: DataFrame, features: list[str], target: str, *, median: str = "exact",
            map_max: int = DEFAULT_MAP_MAX, map_total_max: int = DEFAULT_MAP_TOTAL_MAX,
            broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
            hot_share: float = DEFAULT_HOT_SHARE, salt_buckets: int = DEFAULT_SALT_BUCKETS,
            accuracy: int = 10_000, max_bracket: int | None = None,
            kind_source: DataFrame | None = None, kept: bool = False) -> FittedPrep:
        """Fit on the training rows (target already non-null).  ``kept``: the caller holds the rows, so the passes read those.

        ``kind_source`` (e.g. the whole table before the split) decides whether a bool column has
        nulls - and so is categorical - as a file-level dtype would; by default the training rows do."""
        missing = [c for c in features + [target] if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
        if target in features:
            raise ValueError("the target cannot be a feature")
        # the passes read the fit's own columns; where they come from a split or a join, that is worked out once
        df = with_nan_as_null(df.select(*[qcol(c) for c in dict.fromkeys([*features, target])]))
        if not kept:
            df = df.persist()
        try:
            return cls._fitted(df, features, target, median, map_max, map_total_max, broadcast_bytes, hot_share, salt_buckets, accuracy,
                               max_bracket, kind_source)
        finally:
            if not kept:
                df.unpersist()

    @classmethod
    def _fitted(cls, df: DataFrame, features: list[str], target: str, median: str, map_max: int, map_total_max: int, broadcast_bytes: int,
                hot_share: float, salt_buckets: int, accuracy: int, max_bracket: int | None, kind_source: DataFrame | None) -> FittedPrep:
        types = {f.name: f.dataType for f in df.schema.fields}
        tdt = types[target]
        target_numeric = isinstance(tdt, (T.NumericType, T.BooleanType))
        y = qcol(target).cast("double") if target_numeric else qcol(target)
        bools = [c for c in features if isinstance(types[c], T.BooleanType)]
        maybe_num = [c for c in features if numeric_kind(types[c])] + bools

        # pass A: one aggregation for counts and moments
        aggs = [F.count(F.lit(1)).alias("__n")]
        if target_numeric:
            aggs.append(F.sum(y).alias("__ysum"))
        for i, c in enumerate(features):
            x = qcol(c).cast("double") if c in maybe_num else qcol(c)
            aggs.append(F.count(x).alias(f"c{i}"))
            if c in maybe_num:
                aggs.append(F.avg(x).alias(f"m{i}"))
                aggs.append((F.var_samp(x) * (F.count(x) - 1)).alias(f"q{i}"))
                aggs.append(F.approx_count_distinct(x).alias(f"d{i}"))
        a = df.agg(*aggs).first()
        n = int(a["__n"])
        nn = {c: int(a[f"c{i}"]) for i, c in enumerate(features)}
        nulls = {c: n - nn[c] for c in features}
        kind_nulls = dict(nulls)
        if kind_source is not None and bools:
            kr = kind_source.agg(*[(F.count(F.lit(1)) - F.count(qcol(c))).alias(c) for c in bools]).first()
            kind_nulls.update({c: int(kr[c]) for c in bools})
        num, cat = column_kinds(df, features, kind_nulls)

        # pass B: medians of numeric columns
        num_counts = {c: nn[c] for c in num}
        if not num:
            med = {}
        elif median == "exact":
            sel = df.select(*[qcol(c).cast("double").alias(c) for c in num])
            kw = {"max_bracket": max_bracket} if max_bracket else {}
            about = {c: int(a[f"d{features.index(c)}"]) for c in num}
            med = exact_medians(sel, num_counts, about=about, accuracy=accuracy, **kw)
        else:
            row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), 0.5, accuracy).alias(c) for c in num]).first()
            med = {c: row[c] for c in num if row[c] is not None}
        imputation = {c: float(med[c]) if c in med and med[c] is not None else 0.0 for c in num}

        stats: dict[str, list[float]] = {}
        fit_zero: list[str] = []
        for c in num:
            i = features.index(c)
            fill = med.get(c)
            if fill is None:  # no values: the column becomes 0 (documented deviation, Q3)
                mean, std = 0.0, float("nan")
            else:
                mean, std = _merge_fill_moments(n, nn[c], a[f"m{i}"], a[f"q{i}"], float(fill))
            ok = std is not None and not math.isnan(std) and std > 0
            stats[c] = [mean, std if ok else 1.0]
            if not ok:
                fit_zero.append(c)

        prep = cls(features=list(features), numeric_columns=num, categorical_columns=cat,
                   imputation=imputation, stats=stats, fit_zero=fit_zero,
                   target_numeric=target_numeric, map_max=map_max, map_total_max=map_total_max,
                   broadcast_bytes=broadcast_bytes,
                   salt_buckets=salt_buckets, input_schema=df.select(*[qcol(c) for c in features]).schema.json())
        ysum = float(a["__ysum"] or 0.0) if target_numeric else 0.0
        prep.target_mean = ysum / n if (target_numeric and n) else 0.0

        # pass C: categories
        if cat:
            prep._fit_categories(df, y, n, hot_share)

        # what was done, as (step, columns it touched, cells or rows it changed)
        filled = sum(nulls.values())
        holes = [c for c in features if nulls.get(c)]
        steps = [("fill_median", [c for c in holes if c in num], sum(nulls[c] for c in holes if c in num)),
                 ("fill_mode", [c for c in holes if c in cat], sum(nulls[c] for c in holes if c in cat)),
                 ("encode_target_mean" if target_numeric else "encode_row_share", list(cat), n * len(cat)),
                 ("scale", list(features), n * len(features))]
        prep.report = {"steps": [s for s in steps if s[1]], "processed_rows": n, "num_features": len(features),
                       "nulls_filled": filled, "numeric_columns": num, "categorical_columns": cat}
        return prep

    def _fit_categories(self, df: DataFrame, y: Column, n: int, hot_share: float) -> None:
        spark = df.sparkSession
        cat = self.categorical_columns
        self.n_by_cat = {}
        yv = y if self.target_numeric else F.lit(0.0)  # text target: only counts are used
        long = df.select(yv.alias("__y"), *[qcol(c).cast("string").alias(c) for c in cat]).unpivot(
            "__y", cat, "column", "category")
        grouped = long.groupBy("column", "category").agg(
            F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"))
        grouped = grouped.persist()
        # one aggregation per column over the cached (column, category) table: mode (highest count,
        # smallest value on ties), number of categories and their byte size
        nn = F.col("category").isNotNull()
        srow = grouped.groupBy("column").agg(
            F.min(F.when(nn, F.struct((-F.col("n")).alias("neg"), F.col("category")))).alias("best"),
            F.count("category").alias("k"), F.max(F.when(~nn, 1).otherwise(0)).alias("has_null"),
            F.sum(F.when(nn, F.octet_length("category") + 64).otherwise(0)).alias("bytes")).collect()
        info = {r["column"]: r for r in srow}
        for c in cat:
            best = info[c]["best"]
            self.imputation[c] = best["category"] if best is not None else UNKNOWN_CATEGORY
            k = int(info[c]["k"])
            self.n_categories[c] = k if k > 0 else 1  # an all-null column has the one category UNKNOWN
            self.category_bytes[c] = int(info[c]["bytes"]) + (len(UNKNOWN_CATEGORY) + 16 if k == 0 else 0)
        mode_map = F.create_map(*[x for c in cat for x in (F.lit(c), F.lit(self.imputation[c]))])
        filled = (grouped.withColumn("category", F.coalesce(F.col("category"), mode_map[F.col("column")]))
                  .groupBy("column", "category").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        enc = (F.col("s") / F.col("n")) if self.target_numeric else (F.col("n") / F.lit(float(n)))
        table = filled.select("column", "category", F.col("n").cast("bigint").alias("n"), enc.alias("enc"))
        # map literals for the smallest columns first, within a per-column and a total budget (driver
        # memory and plan size stay bounded however many categorical columns there are)
        small, budget = [], self.map_total_max
        for c in sorted(cat, key=lambda c: self.n_categories.get(c, 0)):
            k = self.n_categories.get(c, 0)
            if k <= self.map_max and k <= budget:
                small.append(c)
                budget -= k
        large = [c for c in cat if c not in small]
        if small:
            # proven small: at most map_max + 1 rows per column; the null group joins its mode here
            merged: dict = {}
            for r in grouped.where(F.col("column").isin(small)).collect():
                key = (r["column"], r["category"] if r["category"] is not None else self.imputation[r["column"]])
                n0, s0 = merged.get(key, (0, 0.0))
                merged[key] = (n0 + int(r["n"]), s0 + float(r["s"] or 0.0))
            for (c, k), (cnt, tot_y) in merged.items():
                e = tot_y / cnt if self.target_numeric else cnt / float(n)
                self.small_encodings.setdefault(c, {})[k] = (e, cnt)
        for c in small:
            items = self.small_encodings.get(c, {})
            encs = [e for e, _ in items.values()]
            self.enc_default[c] = math.fsum(encs) / len(encs) if encs else 0.0
            tot = sum(k for _, k in items.values())
            mean = math.fsum(e * k for e, k in items.values()) / tot if tot else float("nan")
            m2 = math.fsum(k * (e - mean) ** 2 for e, k in items.values()) if tot else float("nan")
            self._set_encoded_stats(c, mean, m2, tot)
            self.n_by_cat.update({(c, k): cnt for k, (_, cnt) in items.items()})
            self.small_encodings[c] = {k: e for k, (e, _) in items.items()}
        if large:
            # cut lineage into the shared checkpoint folder once; statistics and transforms reuse it
            self.encodings = cut_lineage(table)
            big = self.encodings.where(F.col("column").isin(large))
            hot_n = max(1, int(math.ceil(hot_share * n)))
            s1 = {r["column"]: r for r in big.groupBy("column").agg(
                F.avg("enc").alias("u"), F.sum("n").alias("tot"),
                (F.sum(F.col("n") * F.col("enc")) / F.sum("n")).alias("mean"),
                # at most 1/hot_share categories per column can reach hot_n rows
                F.collect_list(F.when(F.col("n") >= F.lit(hot_n), F.col("category"))).alias("hot")).collect()}
            mean_map = F.create_map(*[x for c in large for x in (F.lit(c), F.lit(float(s1[c]["mean"])))])
            s2 = {r["column"]: r["m2"] for r in big.groupBy("column").agg(
                F.sum(F.col("n") * F.pow(F.col("enc") - mean_map[F.col("column")], 2)).alias("m2")).collect()}
            for c in large:
                self.enc_default[c] = float(s1[c]["u"])
                self._set_encoded_stats(c, float(s1[c]["mean"]), float(s2[c]), int(s1[c]["tot"]))
                self.hot_categories[c] = sorted(s1[c]["hot"])
        else:  # proven small (<= map_max rows per column): keep it as local rows
            rows = [(c, k, int(self.n_by_cat.get((c, k), 0)), float(e))
                    for c, items in self.small_encodings.items() for k, e in items.items()]
            self.encodings = spark.createDataFrame(rows, table.schema)
        grouped.unpersist()

    def _set_encoded_stats(self, c: str, mean: float, m2: float, tot: int) -> None:
        std = math.sqrt(m2 / (tot - 1)) if tot > 1 else float("nan")
        ok = not math.isnan(std) and std > 0
        self.stats[c] = [mean, std if ok else 1.0]
        if not ok:
            self.fit_zero.append(c)

    # ------------------------------------------------------------ transform
    def _broadcast_columns(self) -> set:
        """Join-path columns whose encoding table is broadcast: each under ``broadcast_bytes`` and,
        smallest first, all of them together under ``broadcast_total_bytes``."""
        chosen, budget = set(), self.broadcast_total_bytes
        joined = [c for c in self.categorical_columns if c not in self.small_encodings]
        for c in sorted(joined, key=lambda c: self.category_bytes.get(c, 1 << 62)):
            b = self.category_bytes.get(c, 1 << 62)
            if b <= self.broadcast_bytes and b <= budget:
                chosen.add(c)
                budget -= b
        return chosen

    def _encode(self, df: DataFrame, c: str, value: Column, out: str,
                broadcast: bool = False) -> tuple[DataFrame, Column]:
        """Returns (df', encoded column); unseen / null categories take the unweighted mean."""
        default = F.lit(self.enc_default.get(c, 0.0))
        if c in self.small_encodings:
            items = self.small_encodings[c]
            keys = list(items)
            m = F.map_from_arrays(F.lit(keys).cast("array<string>"),
                                  F.lit([items[k] for k in keys]).cast("array<double>"))
            return df, F.coalesce(m[value], default)
        enc = self.encodings.where(F.col("column") == F.lit(c)).select(
            F.col("category").alias(f"__k_{out}"), F.col("enc").alias(f"__e_{out}"))
        kcol = f"__v_{out}"
        df = df.withColumn(kcol, value)
        if broadcast:
            j = df.join(F.broadcast(enc), F.col(kcol) == F.col(f"__k_{out}"), "left")
        else:
            hot = self.hot_categories.get(c, [])
            s = self.salt_buckets if hot else 1
            scol = f"__s_{out}"
            # Any salt is correct (a hot category's encoding is replicated for every salt).  It is a hash of the whole
            # row, so a retried map task deals its rows out as before; rows equal in every column share a salt.
            row = F.xxhash64(*[qcol(x) for x in df.columns if "map" not in df.schema[x].dataType.simpleString()])
            df = df.withColumn(scol, F.when(F.col(kcol).isin(hot), F.pmod(row, F.lit(s)).cast("bigint"))
                               .otherwise(F.lit(0).cast("bigint")))
            enc = enc.withColumn(f"__t_{out}", F.when(F.col(f"__k_{out}").isin(hot),
                                                      F.sequence(F.lit(0).cast("bigint"), F.lit(s - 1).cast("bigint")))
                                 .otherwise(F.array(F.lit(0).cast("bigint"))))
            enc = enc.select("*", F.explode(f"__t_{out}").alias(f"__ts_{out}")).drop(f"__t_{out}")
            j = df.join(enc, (F.col(kcol) == F.col(f"__k_{out}")) & (F.col(scol) == F.col(f"__ts_{out}")), "left")
            j = j.drop(scol, f"__ts_{out}")
        j = j.drop(kcol, f"__k_{out}")
        return j, F.coalesce(F.col(f"__e_{out}"), default)

    def _apply(self, df: DataFrame, keep: list[str], num_value, cat_value, zero_fit: bool,
               prefix: str = "", vector_col: str | None = None) -> DataFrame:
        feats = self.features
        enc_cols: dict[str, Column] = {}
        bc = self._broadcast_columns()
        for c in self.categorical_columns:
            df, enc_cols[c] = self._encode(df, c, cat_value(c), f"f{feats.index(c)}", c in bc)
        out = []
        for c in feats:
            x = num_value(c) if c in self.numeric_columns else enc_cols[c]
            mean, std = self.stats[c]
            if zero_fit and c in self.fit_zero:
                z = F.lit(0.0)
            else:
                z = (x - F.lit(float(mean))) / F.lit(float(std))
            out.append(z.alias(prefix + c))
        if vector_col:
            # one vector column instead of one column per feature: a plan with hundreds of features keeps
            # whole-stage codegen (which stops above spark.sql.codegen.maxFields output fields)
            from pyspark.ml.functions import array_to_vector
            return df.select(*[qcol(k) for k in keep], array_to_vector(F.array(*out)).alias(vector_col))
        return df.select(*[qcol(k) for k in keep], *out)

    def impute(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Nulls replaced by the train medians (numeric, as double) and modes (categorical, as text)."""
        out = [(self._num_fitted(c) if c in self.numeric_columns else self._cat_fitted(c)).alias(c)
               for c in self.features]
        return df.select(*[qcol(k) for k in keep], *out)

    def transform_fit(self, df: DataFrame, keep: list[str] = (), prefix: str = "",
                      vector_col: str | None = None) -> DataFrame:
        """Training rows as fit_transform leaves them (constant columns become 0)."""
        return self._apply(df, list(keep), self._num_fitted, self._cat_fitted, True, prefix, vector_col)

    def transform_test(self, df: DataFrame, keep: list[str] = (), prefix: str = "",
                       vector_col: str | None = None) -> DataFrame:
        """Held-out rows: train medians/modes, encodings and statistics (F1)."""
        return self._apply(df, list(keep), self._num_fitted, self._cat_fitted, False, prefix, vector_col)

    def transform_serving(self, df: DataFrame, keep: list[str] | None = None, fill: str = "reference",
                          prefix: str = "", vector_col: str | None = None) -> DataFrame:
        """New rows (F2): match names by lower/strip (last duplicate wins), missing numeric -> raw 0.0,
        numeric nulls -> 0 (``fill='reference'``) or train medians/modes (``fill='fitted'``); then
        encode (null, missing and unseen categories take the unweighted mean) and z-score."""
        from tabforge.operators.schema import align_mapping

        df = last_of_each_name(df)
        keep = list(df.columns) if keep is None else list(keep)
        mapping = align_mapping(df.columns, self.features)
        fitted = {f["name"]: f["type"] for f in json.loads(self.input_schema)["fields"]} if self.input_schema else {}

        types = {f.name: f.dataType for f in df.schema.fields}

        def src(c: str) -> Column:
            return qcol(mapping[c]) if mapping.get(c) is not None else F.lit(None)

        def parsed(c: str) -> Column:
            # numbers are cast directly; only text inputs are parsed (B9), true/false for features fitted as boolean
            return number(src(c), types.get(mapping.get(c)), fitted.get(c) == "boolean")

        if fill == "fitted":
            num = lambda c: F.coalesce(parsed(c), F.lit(self.imputation[c]))
            cat = lambda c: F.coalesce(src(c).cast("string"), F.lit(self.imputation[c]))
        else:
            num = lambda c: F.coalesce(parsed(c), F.lit(0.0))
            cat = lambda c: src(c).cast("string")
        return self._apply(df, keep, num, cat, False, prefix, vector_col)

    # value expressions per path
    def _num_fitted(self, c: str) -> Column:
        return F.coalesce(nan_to_null(qcol(c).cast("double")), F.lit(self.imputation[c]))

    def _cat_fitted(self, c: str) -> Column:
        return F.coalesce(qcol(c).cast("string"), F.lit(self.imputation[c]))

    # -------------------------------------------------------------- persist
    def _state(self) -> dict:
        # encodings (small ones included) live in Parquet next to the state, not in the JSON row
        return {k: v for k, v in self.__dict__.items() if k not in ("encodings", "n_by_cat", "small_encodings")}

    def save(self, path: str) -> None:
        """Scalars as one JSON text row, encodings as Parquet; both through Spark (shared storage)."""
        spark = SparkSession.getActiveSession()
        state = json.dumps(self._state(), allow_nan=True)
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        if self.encodings is not None:
            self.encodings.write.mode("overwrite").parquet(f"{path}/encodings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPrep:
        state = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/state").collect()))
        prep = cls(**state)
        if prep.categorical_columns:
            prep.encodings = spark.read.parquet(f"{path}/encodings")
            small = [c for c in prep.categorical_columns if c not in prep.hot_categories]
            if small:  # proven small at fit: at most map_max rows per column
                for r in prep.encodings.where(F.col("column").isin(small)).collect():
                    prep.small_encodings.setdefault(r["column"], {})[r["category"]] = float(r["enc"])
        return prep


def stats_frame(spark: SparkSession, prep: FittedPrep) -> DataFrame:
    rows = [(c, "numeric" if c in prep.numeric_columns else "categorical", float(m), float(s))
            for c, (m, s) in prep.stats.items()]
    return spark.createDataFrame(rows, "column string, kind string, mean double, std double")


def imputation_frame(spark: SparkSession, prep: FittedPrep) -> DataFrame:
    rows = [(c, "numeric" if c in prep.numeric_columns else "categorical",
             float(v) if c in prep.numeric_columns else None,
             None if c in prep.numeric_columns else str(v)) for c, v in prep.imputation.items()]
    return spark.createDataFrame(rows, "column string, kind string, num_value double, cat_value string")


def report_frame(spark: SparkSession, prep: FittedPrep, original_rows: int | None = None) -> DataFrame:
    r = prep.report
    row = ([(step, list(cols), int(cells)) for step, cols, cells in r["steps"]], int(r["processed_rows"]), int(r["num_features"]), int(r["nulls_filled"]),
           r["numeric_columns"], r["categorical_columns"], original_rows)
    return spark.createDataFrame([row], "steps array<struct<step:string,columns:array<string>,cells:bigint>>, processed_rows bigint, num_features int, "
                                        "nulls_filled bigint, numeric_columns array<string>, "
                                        "categorical_columns array<string>, original_rows bigint")


def fit_transform(df: DataFrame, features: list[str], target: str, keep: list[str] = (), **kw
                  ) -> tuple[DataFrame, FittedPrep]:
    prep = FittedPrep.fit(df, features, target, **kw)
    return prep.transform_fit(df, keep), prep


def prep_full_table(df: DataFrame, features: list[str], target: str, keep: list[str] = (), **kw
                    ) -> tuple[DataFrame, FittedPrep, int]:
    """Whole-table variant (E11): drop null targets, then fit on all remaining rows."""
    from tabforge.operators.schema import drop_null_target

    kept, original, _removed = drop_null_target(df, target)
    out, prep = fit_transform(kept, features, target, keep=keep, **kw)
    if _removed:
        prep.report["steps"].insert(0, ("drop_null_target", [target], _removed))
    return out, prep, original


__all__ = ["FittedPrep", "column_kinds", "fit_transform", "prep_full_table", "stats_frame",
           "imputation_frame", "report_frame", "norm_name"]
