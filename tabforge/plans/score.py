"""Scoring (I1-I9): apply a saved preparation + model to new rows, in batch or per record.

Scoring is narrow from scan to sink: the serving transform is one projection
(literals and map lookups; large encodings join by key), the model transform is
row-wise, so no shuffle happens and the job scales with the input splits.
The model is loaded once per job, and one ``transform`` yields both labels and
probabilities.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.exprs import last_of_each_name, qcol
from tabforge.operators.prep import FittedPrep
from tabforge.operators.schema import attach_prediction, check_schema
from tabforge.plans.train import index_to_label, model_class, probability_array, without_summary
from tabforge.sources.committed import write_committed


_MODEL_COLUMNS = ("features", "prediction", "rawprediction", "probability")


@dataclass
class ScoringBundle:
    prep: FittedPrep
    model: object
    problem_type: str
    algorithm_name: str
    labels: list | None = None
    label_type: str | None = None  # Spark type of the target (class names keep their own type)

    def __post_init__(self) -> None:
        without_summary(self.model)

    @property
    def has_probabilities(self) -> bool:
        return self.problem_type == "classification"

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.prep.save(f"{path}/prep")
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"problem_type": self.problem_type, "algorithm_name": self.algorithm_name,
                           "labels": self.labels, "label_type": self.label_type})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringBundle:
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
        labels = meta["labels"]
        mc = model_class(meta["problem_type"], len(labels or []), meta["algorithm_name"])
        return cls(FittedPrep.load(spark, f"{path}/prep"), mc.load(f"{path}/model"), meta["problem_type"],
                   meta["algorithm_name"], labels, meta.get("label_type"))

    # ---------------------------------------------------------------- core
    def _label_dt(self):
        from pyspark.sql.types import _parse_datatype_string
        return _parse_datatype_string(self.label_type) if self.label_type else None

    def scored(self, df: DataFrame, fill: str = "reference") -> DataFrame:
        """All input columns plus ``__label`` (class or number) and ``__proba`` (array, classification)."""
        df = last_of_each_name(df)
        clash = [c for c in df.columns if c.lower() in _MODEL_COLUMNS]
        src = df.select(*[qcol(c).alias("__in_" + c) if c in clash else qcol(c) for c in df.columns])
        x = self.prep.transform_serving(src, keep=list(src.columns), fill=fill, vector_col="features")
        out = self.model.transform(x)
        if self.has_probabilities:
            out = out.withColumn("__proba", probability_array(out, self.model))
            out = out.withColumn("__label", index_to_label(F.col("prediction"), self.labels, self._label_dt()))
        else:
            out = out.withColumn("__label", F.col("prediction"))
        keep = [qcol(c).alias(c[5:]) if c.startswith("__in_") and c[5:] in clash else qcol(c) for c in src.columns]
        extra = ["__label"] + (["__proba"] if self.has_probabilities else [])
        return out.select(*keep, *[F.col(c) for c in extra])

    def predict(self, df: DataFrame, keep: list[str] | None = None, return_probabilities: bool = False) -> DataFrame:
        """I1 (+I4): class label or number per row; with ``return_probabilities`` (classification only) a
        map class -> probability as well."""
        df = last_of_each_name(df)
        s = self.scored(df)
        cols = [qcol(c) for c in (keep if keep is not None else df.columns)] + [F.col("__label").alias("prediction")]
        if return_probabilities and self.has_probabilities:
            cols.append(self.proba_map().alias("probabilities"))
        return s.select(*cols)

    def proba_map(self) -> Column:
        """Map class name -> probability; I3: a model without probabilities gives {prediction: 1.0}."""
        if self.has_probabilities:
            keys = F.array(*[F.lit(str(lab)) for lab in self.labels])
            return F.map_from_arrays(keys, F.col("__proba"))
        return F.create_map(F.col("__label").cast("string"), F.lit(1.0))

    def predict_proba(self, df: DataFrame, keep: list[str] | None = None, allow_regression: bool = False
                      ) -> DataFrame:
        """Probabilities only make sense for classification; a regression bundle is rejected
        unless ``allow_regression`` (then each row gets the degenerate map {prediction: 1.0}, I3)."""
        if not self.has_probabilities and not allow_regression:
            raise ValueError("probabilities are only available for classification models")
        df = last_of_each_name(df)
        s = self.scored(df)
        return s.select(*[qcol(c) for c in (keep if keep is not None else df.columns)],
                        self.proba_map().alias("probabilities"))

    def predict_batch(self, df: DataFrame) -> DataFrame:
        """All input columns plus ``prediction`` = P(second class) for binary, the class plus
        ``prob_{class}`` columns for multiclass, the number for regression."""
        s = self.scored(df)
        if self.has_probabilities and len(self.labels) == 2:
            out = attach_prediction(s.drop("__label"), F.col("__proba")[1])
        elif self.has_probabilities:
            out = attach_prediction(s, F.col("__label"))
            # columns of an earlier scoring are replaced
            named = {f"prob_{lab}".lower() for lab in self.labels} | {"__label", "__proba"}
            out = out.select(*[qcol(c) for c in out.columns if c.lower() not in named],
                             *[F.col("__proba")[i].alias(f"prob_{lab}") for i, lab in enumerate(self.labels)])
        else:
            out = attach_prediction(s, F.col("__label"))
        return out.drop("__label", "__proba")


def batch_job(spark: SparkSession, bundle: ScoringBundle, df: DataFrame, out_path: str, fmt: str = "parquet",
              threshold: float = 0.5, log_dir: str | None = None) -> dict:
    """Compatibility gate (B6) -> score -> committed write -> summary row (I8).  The input is read once: row count, null
    count and range of the predictions are observed by the tasks that write, and the result is visible only once its commit row
    is there (``sources.committed``); rows come back in the types they were written with.  With ``log_dir`` the summary row
    is appended to ``{log_dir}/batch_results`` (lookup by id survives restarts, Q14)."""
    check_schema(df.columns, bundle.prep.features, threshold)
    done = write_committed(bundle.predict_batch(df), out_path, fmt, ["prediction"])
    result = done.rows(spark)
    summary = {"result_id": str(uuid.uuid4()), "path": done.path, "fmt": fmt, "num_rows": done.num_rows, "facts": done.facts,
               "result": result, "preview": result.limit(10)}
    if log_dir:
        batch_summary_frame(spark, summary).write.mode("append").parquet(f"{log_dir}/batch_results")
    return summary


def batch_summary_frame(spark: SparkSession, summary: dict) -> DataFrame:
    """I8: run-log row for a batch result."""
    import datetime as _dt
    return spark.createDataFrame([(summary["result_id"], summary["path"], int(summary["num_rows"]),
                                   _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), summary.get("fmt", "parquet"))],
                                 "result_id string, path string, num_rows bigint, created_at timestamp_ntz, fmt string")
