"""Stream scoring (I10): unbounded records in, scored records out.

The serving transform and the model are stateless row-wise projections, so the
stream needs no watermark and no state store: each micro-batch is scored like a
batch (encodings are a static side: map literals, or a key join with a static
DataFrame).  The checkpoint location is in the shared checkpoint folder, so a
restarted query resumes where it stopped, and file sinks commit exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.plans.score import ScoringBundle
from tabforge.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not any(ch in name for ch in "*?["):
        # a single file: the file source watches folders, so watch the folder through a one-file glob
        path = path.rstrip("/")[:-1] + "[" + path.rstrip("/")[-1] + "]"
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(bundle: ScoringBundle, stream: DataFrame, keep: list[str] | None = None,
                 probabilities: bool = False) -> DataFrame:
    """Scored stream: kept columns + ``prediction`` (+ ``probabilities`` map for classification)."""
    return bundle.predict(stream, keep=keep, return_probabilities=probabilities)


def prep_stream(bundle_or_prep, stream: DataFrame, keep: list[str]) -> DataFrame:
    """Serving transform alone on a stream (z-scored feature columns)."""
    prep = getattr(bundle_or_prep, "prep", bundle_or_prep)
    return prep.transform_serving(stream, keep=keep)


def run_available_now(df: DataFrame, out_path: str, checkpoint: str | None = None, fmt: str = "parquet") -> str:
    """Process everything available now into a file sink and stop (restartable from the checkpoint)."""
    spark = df.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    return out_path


def stream_to_table(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Runs the stream to completion into a scratch folder and returns the written rows."""
    spark = df.sparkSession
    out = scratch_path(spark, "stream-out")
    run_available_now(df, out, fmt=fmt)
    return spark.read.format(fmt).load(out)


__all__ = ["read_stream", "score_stream", "prep_stream", "run_available_now", "stream_to_table", "F"]
